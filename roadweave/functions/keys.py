"""Content keys and seeds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_key(**fields: Column | None) -> Column:
    """sha256 of compact JSON with sorted keys; fields given as ``None`` are left out."""
    present = sorted((k, v) for k, v in fields.items() if v is not None)
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in present])), 256)


def bbox_key(west: Column, south: Column, east: Column, north: Column) -> Column:
    return content_key(
        type=F.lit("bbox"),
        west=F.bround(west, 6), south=F.bround(south, 6), east=F.bround(east, 6), north=F.bround(north, 6),
    )


def map_key(box_key: Column) -> Column:
    return content_key(type=F.lit("osm"), bbox_key=box_key)


def network_key(osm_key: Column, car_only: Column, seed: Column) -> Column:
    return content_key(type=F.lit("network"), osm_key=osm_key, car_only=car_only, seed=seed)


def traffic_key(
    box_key: Column, provider: Column, bucket: Column, zoom: Column | None = None, style: Column | None = None
) -> Column:
    return content_key(
        type=F.lit("traffic"), bbox_key=box_key, provider=provider, timestamp_bucket=bucket, zoom=zoom, style=style
    )


def matching_key(box_key: Column, net_key: Column, provider: Column, bucket: Column) -> Column:
    return content_key(
        type=F.lit("matching"), bbox_key=box_key, network_key=net_key, provider=provider, timestamp_bucket=bucket
    )


def _swap_bytes(hex16: Column) -> Column:
    pairs = [F.substring(hex16, i, 2) for i in range(15, 0, -2)]
    return F.concat(*pairs)


def stable_seed(genes: Column, base_seed: Column) -> Column:
    """First eight bytes (little endian) of the genome's sha256, xor the base seed, modulo 2^32 - 1."""
    words = F.transform(genes, lambda g: _swap_bytes(F.lpad(F.hex(g.cast("bigint")), 16, "0")))
    digest = F.sha2(F.unhex(F.concat_ws("", words)), 256)
    head = _swap_bytes(F.substring(digest, 1, 16))
    # conv yields an unsigned 64-bit number; split in halves so that xor stays within bigint.
    high = F.conv(F.substring(head, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(head, 9, 8), 16, 10).cast("bigint")
    base = base_seed.cast("bigint")
    base_high = F.shiftrightunsigned(base, 32)
    base_low = base.bitwiseAND(F.lit(4294967295))
    # 2^32 is congruent to 1 modulo 2^32 - 1, so the two halves simply add up.
    return F.pmod(high.bitwiseXOR(base_high) + low.bitwiseXOR(base_low), F.lit(4294967295))


def _drawn(seed: int, parts: tuple[Column | str | int, ...]) -> Column:
    """52 bits of the md5 of the seed and the parts joined as text: any SQL engine can draw the same numbers."""
    cols = [F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def uniform(seed: int, *parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends only on the named columns and values, never on the partitioning."""
    return _drawn(seed, parts).cast("double") / float(1 << 52)


def uniform_int(n: Column, seed: int, *parts: Column | str | int) -> Column:
    """A number in 0..n-1."""
    return F.pmod(_drawn(seed, parts), n.cast("bigint"))
