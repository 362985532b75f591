"""Column functions over numbers and arrays: training objectives, buckets and batch sizes, names, list edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.sequences import pad_or_trim


def clipped_objective(log_ratio: Column, advantage: Column, clip: float = 0.2) -> Column:
    """The smaller of ratio * advantage and its clipped form."""
    ratio = F.exp(log_ratio)
    return F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip)) * advantage)


def divergence_estimate(d: Column) -> Column:
    return F.exp(d) - d - 1


def preference_loss(delta: Column, beta: float = 0.1, smoothing: float = 0.0) -> Column:
    """-log sigmoid(beta * delta), with a share `smoothing` of the loss for the opposite preference."""
    x = delta * beta
    return F.log1p(F.exp(-x)) * (1 - smoothing) + F.log1p(F.exp(x)) * smoothing


def two_threshold_bucket(n_in: Column, n_out: Column, lengths: list[int]) -> Column:
    """First length L with n_in <= L and n_in + 3 * n_out <= 2 * L; else the largest if n_in fits it, else null."""
    fits = F.filter(F.array(*map(F.lit, sorted(lengths))), lambda b: (n_in <= b) & (n_in + n_out * 3 <= b * 2))
    return F.coalesce(F.array_min(fits), F.when(n_in <= max(lengths), F.lit(max(lengths))))


def balanced_batch(n: Column, most: int, ratio: float = 1.0) -> Column:
    """n if it fits, else the size of equal parts times a margin."""
    return F.when(n <= most, n).otherwise(F.ceil(n / F.ceil(n / most) * ratio)).cast("long")


def node_count(device: Column, chips: Column) -> Column:
    """Hosts of a slice: 4 chips each for v*, 8 for a3*, one otherwise."""
    return F.when(device.startswith("v"), F.floor(chips / 4)).when(device.startswith("a3"), F.floor(chips / 8)).otherwise(chips).cast("long")


def cache_key(text: Column, *parts: Column) -> Column:
    """sha256 of the parts and the text's own sha256, joined by bars."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts), F.sha2(text, 256)), 256)


def shard_name(x: Column) -> tuple[Column, Column, Column]:
    """(stem, number, count) of `stem-00003-of-00008`; nulls for other names."""
    part = lambda i: F.nullif(F.regexp_extract(x, r"^(.*)-(\d{5})-of-(\d{5})", i), F.lit(""))
    return part(1), part(2).cast("int"), part(3).cast("int")


def bucket_and_prefix(uri: Column) -> tuple[Column, Column]:
    """(bucket, prefix) of scheme://bucket/prefix."""
    part = lambda i: F.regexp_extract(uri, r"^[a-z0-9]+://([^/]+)/?(.*)$", i)
    return part(1), part(2)


def test_summary(line: Column) -> tuple[Column, Column]:
    """(passed, failed) of a test runner's last line; 0 where a count doesn't appear."""
    n = lambda word: F.coalesce(F.nullif(F.regexp_extract(line, rf"(\d+) {word}", 1), F.lit("")).cast("int"), F.lit(0))
    return n("passed"), n("failed")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    unlike = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(unlike == 0, n).otherwise(unlike - 1).cast("long")


def insert_sequence(x: Column, marker: int, sequence: list[int], length: int) -> Column:
    """Each marker replaced by a sequence; cut or filled with zeros to a fixed length."""
    whole = F.array(*map(F.lit, sequence))
    return pad_or_trim(F.flatten(F.transform(x, lambda t: F.when(t == marker, whole).otherwise(F.array(t)))), length)


def alternate(a: Column, b: Column) -> Column:
    """a[0], b[0], a[1], b[1], ... as far as both go."""
    n = F.least(F.size(a), F.size(b))
    return F.flatten(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.array(x, y)))
