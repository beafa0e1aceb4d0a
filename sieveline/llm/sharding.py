"""Documents dealt to shards by jump consistent hashing: no table of a ring, and one more shard takes rows only into itself.

A key's jumps are one fixed increasing sequence of shard numbers; its shard is the last of them below the number of shards. So the shard
depends on the key and that number alone, and with one more shard a row either stays or, if the next jump is that shard, moves there. The
numbers behind the jumps come from a linear congruential generator of 64 bits, started with the first 64 bits of the key's MD5, so keys of
any type are even over the shards. All of it is column expressions: the generator's state is three limbs of 22, 22 and 20 bits, since long
products would overflow.

Defined results: a null key is the empty text; rows of one key share a shard, whatever their texts; null texts are empty; repeated rows each
have a slot, and which of two equal rows has which is open; other columns play no part; an empty table gives none. Equal texts with
different keys are not held together, since the key alone decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.places import numbered

#: The generator's factor, in limbs.
FACTOR = 2862933555777941757
_LIMB = (1 << 22) - 1
_F0, _F1, _F2 = FACTOR & _LIMB, (FACTOR >> 22) & _LIMB, FACTOR >> 44
#: Jumps written out as projections; a key that needs more, one in billions, takes them in a loop over an array.
UNROLLED = 24


def key_limbs(key: Column) -> tuple[Column, Column, Column]:
    """The first 64 bits of the MD5 of a key's text, as limbs from the lowest."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    low = F.conv(F.substring(digest, 6, 11), 16, 10).cast("long")
    return low.bitwiseAND(F.lit(_LIMB)), F.shiftright(low, 22), F.conv(F.substring(digest, 1, 5), 16, 10).cast("long")


def _next(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """The generator's next state: the state times the factor plus 1, modulo 2^64, limb by limb with carries."""
    low = a * _F0 + 1
    mid = a * _F1 + b * _F0 + F.shiftright(low, 22)
    high = a * _F2 + b * _F1 + c * _F0 + F.shiftright(mid, 22)
    return low.bitwiseAND(F.lit(_LIMB)), mid.bitwiseAND(F.lit(_LIMB)), high.bitwiseAND(F.lit((1 << 20) - 1))


def _jump(at: Column, b: Column, c: Column) -> Column:
    """The jump after shard `at`: its state's top 31 bits are a part of 2^31."""
    top = F.shiftleft(c, 11) + F.shiftright(b, 11)
    return F.floor((at + 1) * (F.lit(float(1 << 31)) / (top + 1))).cast("long")


def with_shards(df: DataFrame, key: str = "doc_id", shards: int = 8, shard: str = "shard", grown: str | None = "grown_shard") -> DataFrame:
    """df with the shard of each row, and with the one that it has if a shard is appended; columns of these names are replaced."""
    if not 0 < shards < 1 << 31:
        raise ValueError("shards must be from 1 to 2^31 - 1")
    a, b, c, last, jump = (f"jump {x}" for x in ("a", "b", "c", "last", "next"))
    col = lambda name: F.col(f"`{name}`")
    new = [shard, *([grown] if grown else [])]
    kept = [col(x) for x in df.columns if x not in new or x == key]
    own = df.select(*kept, *(v.alias(n) for v, n in zip(key_limbs(col(key)), (a, b, c))), F.lit(-1).cast("long").alias(last), F.lit(0).cast("long").alias(jump))
    names = own.columns[:-5]
    for _ in range(min(shards, UNROLLED)):
        own = own.select(*map(col, names), *(v.alias(n) for v, n in zip(_next(col(a), col(b), col(c)), (a, b, c))), col(last), col(jump))
        on = col(jump) < shards
        own = own.select(*map(col, names), col(a), col(b), col(c), F.when(on, col(jump)).otherwise(col(last)).alias(last), F.when(on, _jump(col(jump), col(b), col(c))).otherwise(col(jump)).alias(jump))
    if shards > UNROLLED:
        state = F.struct(col(a).alias("a"), col(b).alias("b"), col(c).alias("c"), col(last).alias("last"), col(jump).alias("jump"))

        def step(s: Column, _: Column) -> Column:
            x, y, z = _next(s["a"], s["b"], s["c"])
            return F.when(s["jump"] >= shards, s).otherwise(F.struct(x.alias("a"), y.alias("b"), z.alias("c"), s["jump"].alias("last"), _jump(s["jump"], y, z).alias("jump")))

        rest = F.when(col(jump) >= shards, state).otherwise(F.aggregate(F.sequence(F.lit(UNROLLED), F.lit(shards)), state, step))
        own = own.select(*map(col, names), rest.alias("jump rest")).select(*map(col, names), *(F.col(f"`jump rest`.`{s}`").alias(n) for s, n in (("last", last), ("jump", jump))))
    found = [col(last).cast("int").alias(shard)]
    if grown:
        found.append(F.when(col(jump) == shards, F.lit(shards)).otherwise(col(last)).cast("int").alias(grown))
    return own.select(*(col(x) for x in names if x not in new), *found)


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of each row; slots count from 0 in each shard, by key, checksum and size.

    Only these narrow rows are sorted, in ranges of (shard, key), so no task holds a shard and a hot key is dealt over ranges.
    """
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    slim = docs.select(F.col(f"`{key}`"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    order = [F.asc_nulls_first(f"`{key}`"), F.asc("text_crc32"), F.asc("size")]
    placed = numbered(with_shards(slim, key, shards), order, "slot", ["shard"], first=0)
    return placed.select(F.col(f"`{key}`"), "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id", text: str = "text", file_bytes: int = 256 << 20) -> None:
    """The whole rows as Parquet, a folder `shard=N` for each shard.

    Files hold about file_bytes of texts: rows go to as many writers a shard as its bytes ask for, dealt by where they were read, so neither a
    large shard nor a hot key meets in one task.
    """
    own = with_shards(docs, key, shards, grown=None)
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).head()[0] or 0
    each = max(1, round(total / shards / file_bytes))
    dealt = own.withColumn("shard writer", F.monotonically_increasing_id() % each)
    dealt.repartition(shards * each, "shard", "`shard writer`").drop("shard writer").write.partitionBy("shard").parquet(path)


#: The same in SQL: the generator as 128-bit products, the checksum byte by byte from its table (polynomial 0xEDB88320).
SQL = f"""WITH RECURSIVE bits AS (SELECT 0 AS i, CAST(range AS BIGINT) AS c, CAST(range AS BIGINT) AS k FROM range(256)
  UNION ALL SELECT i + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, k FROM bits WHERE i < 8),
 tab AS (SELECT list(c ORDER BY k) AS tab FROM bits WHERE i = 8),
 doc AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
 slim AS (SELECT r, doc_id, CAST(octet_length(b) AS BIGINT) + 1 AS size, CAST(xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
   list_transform(string_split(regexp_replace(hex(b), '(..)', '\\1 ', 'g'), ' ')[1:octet_length(b)], lambda x: CAST('0x' || x AS BIGINT))), lambda c, v: xor(c >> 8, tab[CAST((xor(c, v) & 255) + 1 AS BIGINT)]))) AS BIGINT) AS text_crc32 FROM doc, tab),
 jumps AS (SELECT r, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT) AS HUGEINT) AS k, CAST(-1 AS BIGINT) AS last, CAST(0 AS BIGINT) AS jump FROM slim
  UNION ALL SELECT r, k, jump, CAST(floor((jump + 1) * (2147483648.0::DOUBLE / (CAST(k // 8589934592 AS DOUBLE) + 1))) AS BIGINT) FROM (SELECT r, (k * {FACTOR} + 1) % 18446744073709551616 AS k, last, jump FROM jumps WHERE jump < 8)),
 dealt AS (SELECT r, last AS shard, CASE WHEN jump = 8 THEN 8 ELSE last END AS grown_shard FROM jumps WHERE jump >= 8)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM slim JOIN dealt USING (r)"""
