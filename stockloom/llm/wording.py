"""Words of texts, as bytes. ASCII white space and letters are single bytes in UTF-8, so bytes can be cut without decoding."""

import pyarrow as pa
from pyspark.sql import functions as F

#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z, keeps digits, letters and all of the other scripts; the rest of ASCII becomes a space.
ALPHANUMERIC = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def spaced_words(text, table=None):
    """Words between ASCII white space (bytes.split() knows no other); None has none."""
    if not text:
        return []
    return text.translate(table).split() if table else text.split()


def as_bytes(array):
    """A text column as bytes objects or None, one after the other."""
    for value in array.cast(pa.large_binary()):
        yield value.as_py()


def packed(docs, **named):
    """All columns in one struct `row`, beside the named expressions: no name of an input column can clash."""
    return docs.select(F.struct("*").alias("row"), *[F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in named.items()])


def text_hash(column="text"):
    """64 bits to tell rows of one id apart."""
    return F.xxhash64(column)
