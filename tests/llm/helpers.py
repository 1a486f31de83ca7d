"""Small hostile inputs that every llm operator must bear, and brute-force helpers."""

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
HOSTILE = [None, "", " ", "\n\n\n", "a", "\t \x0b\x0c\r", "İstanbul ÇA ß ǅ", "x" * 5000, "…—“ ”   end", "one two three four five six seven", "<|endoftext|> it's we'll 12345 <|startoftext|>!!", "a  b   c \n\n  d\n \n", "\x00\x01\x1c\x1f\x85 z", "日本語のテキスト" * 50, LONG, LONG, "same same " * 300, "é ́ ≮ x"]


#: Names of extra columns that the operators use themselves.
CLASHING = "h route lang_pred score kept component component_id ids sequence_id offset found runs payload digest bands shingles removed covered_words held_out n k1 node key n_words size class".split()


def frame(spark: SparkSession, texts=None, extra: bool = True, parts: int = 3) -> DataFrame:
    texts = HOSTILE if texts is None else texts
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
    return df.selectExpr("*", *[f"'clash' as `{x}`" for x in CLASHING]) if extra else df


def with_null_id(df: DataFrame) -> DataFrame:
    return df.unionByName(df.limit(3).selectExpr("cast(null as long) doc_id", *[c for c in df.columns if c != "doc_id"]))
