"""Rows of a large table that a small one asks for, found without shuffling the large one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map that asked keys are marked in, at least and at most; as words of 64 bits at most BITS_MOST / 64 rows are broadcast
#: (4 MB of data).
BITS_LEAST, BITS, BITS_MOST = 1 << 16, 1 << 23, 1 << 24


def marked(rows: DataFrame, asked: DataFrame, key: str = "key", many: int | None = None) -> DataFrame:
    """The rows whose key is marked in a bit map of the keys asked for: all that are asked for, and few others.

    The map is built in the tasks and broadcast; its size is bounded by BITS_MOST. So the rows are only read, and what is shuffled
    afterwards follows the number of keys asked for. many: about how many these are, if known: the map then has 16 bits a key, as far as
    its bound reaches. Beyond some 10 million keys it lets more and more other rows pass, which cost a shuffle but change no result.
    """
    bits = BITS if many is None else min(BITS_MOST, max(BITS_LEAST, 1 << (16 * many).bit_length()))
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    word, at = F.floor(bit / 64).alias("_word"), (bit % 64).cast("int").alias("_at")
    words = asked.select(word, at).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _at))").alias("_marks"))
    found = rows.select("*", word, at).join(F.broadcast(words), "_word")
    return found.where(F.expr("_marks & shiftleft(1L, _at) <> 0L")).select(*rows.columns)
