import re
import zlib

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
#: Texts of every odd kind: null, empty, blank, one word, no spaces, repeats, long, not ASCII.
ODD = [
    None, "", " ", "\n\n", "word", "a b c d", "x" * 3000, "de " * 700, "Ünï cödé ß 漢字 🙂 " * 30, "one two three four five six seven eight nine ten eleven",
    "one two three four five six seven eight nine ten eleven", "\x00 \x0b tab\tnew\nline", "LONG " * 5 + "line\n" * 40, "1.2.3.4 a@b.c_d@e.f +1 (123) 555-1234", "▁ ▁", "0" * 5000, "a." * 2000, "a@" * 2000,
]


def documents(spark, texts, more=False):
    """doc_id, text, lang, source, n_chars; more: columns whose names clash with results."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if more:
        for c in ("n_words", "score", "kept", "id", "key", "h", "p", "fp", "iv", "rep", "items", "hits", "predicted", "n_lines", "n_removed", "shard", "slot", "size", "row", "bucket", "lines", "base", "t", "spans"):
            df = df.selectExpr("*", f"'{c}' as `{c}`")
    return df


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n
