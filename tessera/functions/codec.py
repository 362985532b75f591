"""Column functions of the measurement codec: bytes as tokens, addresses, round-trip times, time stamps."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
BYTE_OFFSET = 11
VOCABULARY = 267
START, SRC4, DST4, SRC6, DST6, TIME_ABS, TIME_D1, RTT, TIME_D4, FAILED = 0, 1, 2, 3, 4, 5, 6, 8, 7, 10


def byte_to_token(b: Column) -> Column:
    return (b + BYTE_OFFSET).cast("int")


def token_to_byte(t: Column) -> Column:
    return (t - BYTE_OFFSET).cast("int")


def ipv4_tokens(address: Column) -> Column:
    """Four tokens; blank or null is 0.0.0.0, what isn't a dotted quad is an error."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    a = F.when(F.coalesce(F.btrim(address), F.lit("")) == "", "0.0.0.0").otherwise(F.btrim(address))
    a = F.when(a.rlike(rf"^({octet}\.){{3}}{octet}$"), a).otherwise(F.raise_error(F.concat(F.lit("not an IPv4 address: "), a)))
    return F.transform(F.split(a, r"\."), lambda x: byte_to_token(x.cast("int")))


def ipv6_tokens(address: Column) -> Column:
    """Sixteen tokens; blank or null is `::`. Groups of hex digits, one run of zeros as `::`, the last two groups perhaps as a
    dotted quad; anything else is an error."""
    a = F.when(F.coalesce(F.btrim(address), F.lit("")) == "", "::").otherwise(F.btrim(address))
    octets = F.transform(F.split(F.regexp_extract(a, r"((\d{1,3}\.){3}\d{1,3})$", 1), r"\."), lambda x: x.try_cast("int"))
    pair = lambda i: F.lower(F.hex(octets[i] * 256 + octets[i + 1]))
    small = F.forall(octets, lambda x: x.between(0, 255))
    plain = F.when(a.rlike(r":(\d{1,3}\.){3}\d{1,3}$") & small, F.concat(F.regexp_replace(a, r"(\d{1,3}\.){3}\d{1,3}$", ""), pair(0), F.lit(":"), pair(2))).otherwise(a)
    groups = lambda x: F.filter(F.split(x, ":", -1), lambda g: F.lit(True))
    none = F.array().cast("array<string>")
    halves = F.split(plain, "::", -1)
    side = lambda x: F.when(F.coalesce(x, F.lit("")) == "", none).otherwise(groups(x))
    left, right = side(F.get(halves, F.lit(0))), side(F.get(halves, F.lit(1)))
    short = F.size(halves) == 2
    missing = F.lit(8) - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    right_size = (short & (missing >= 1)) | ((F.size(halves) == 1) & (missing == 0))
    fine = right_size & F.forall(whole, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    checked = F.when(fine, whole).otherwise(F.raise_error(F.concat(F.lit("not an IPv6 address: "), a)))
    number = lambda g: F.conv(g, 16, 10).cast("int")
    return F.flatten(F.transform(checked, lambda g: F.array(byte_to_token(F.floor(number(g) / 256)), byte_to_token(number(g) % 256))))


def merged_address(address: Column, version: Column, source: bool) -> Column:
    """The address behind the token of its role, by version 4 or 6; another version is an error."""
    wrong = F.raise_error(F.concat(F.lit("no IP version: "), F.coalesce(version.cast("string"), F.lit("null"))))
    six = F.concat(F.array(F.lit(SRC6 if source else DST6)), ipv6_tokens(address))
    return F.when(version == 4, address_block(address, source)).when(version == 6, six).otherwise(wrong)


def address_block(address: Column, source: bool) -> Column:
    return F.concat(F.array(F.lit(SRC4 if source else DST4)), ipv4_tokens(address))


def rtt_parts(ms: Column) -> tuple[Column, Column]:
    """(exponent, mantissa): microseconds, at least 1, as 5 and 11 bits, truncating."""
    us = F.greatest(F.lit(1).cast("long"), F.floor(ms * 1000.0))
    e = F.least(F.lit(31), F.greatest(F.lit(0), F.length(F.bin(us)) - 11))
    return e, F.least(F.lit(2047).cast("long"), F.floor(us / F.pow(F.lit(2.0), e)))


def rtt_bytes(ms: Column) -> tuple[Column, Column]:
    e, m = rtt_parts(ms)
    word = e * 2048 + m
    return F.floor(word / 256).cast("int"), (word % 256).cast("int")


def rtt_block(ms: Column) -> Column:
    b1, b2 = rtt_bytes(ms)
    return F.when(ms < 0, F.array(F.lit(FAILED))).otherwise(F.array(F.lit(RTT), byte_to_token(b1), byte_to_token(b2)))


def rtt_decode(b1: Column, b2: Column) -> Column:
    """Milliseconds."""
    word = b1 * 256 + b2
    return (word % 2048) * F.pow(F.lit(2.0), F.floor(word / 2048)) / 1000.0


def big_endian(value: Column, size: int) -> Column:
    """Tokens of an unsigned number in `size` bytes; negative or too large is an error."""
    fits = (value >= 0) & (F.lit(size >= 8) | (value < F.lit(1 << min(62, 8 * size))))
    value = F.when(fits, value.cast("long")).otherwise(F.raise_error(F.lit("number out of range")))
    return F.array(*(byte_to_token(F.shiftrightunsigned(value, 8 * (size - 1 - i)).bitwiseAND(F.lit(255))) for i in range(size)))


def time_block(seconds: Column, previous: Column) -> Column:
    """Absolute without a previous row, else the delta in one byte or four; a negative delta counts as 0."""
    delta = F.greatest(F.lit(0).cast("long"), seconds - previous)
    one = F.concat(F.array(F.lit(TIME_D1)), F.array(byte_to_token(delta)))
    return (
        F.when(previous.isNull(), F.concat(F.array(F.lit(TIME_ABS)), big_endian(seconds, 8)))
        .when(delta < 256, one)
        .otherwise(F.concat(F.array(F.lit(TIME_D4)), big_endian(delta, 4)))
    )


def shuffle_seed(src: Column, dst: Column, seconds: Column) -> Column:
    """First four bytes of the md5 of `src|dst|seconds`."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(src, F.lit("")), F.coalesce(dst, F.lit("")), seconds.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def measurement_tokens(src: Column, dst: Column, ms: Column, seconds: Column, previous: Column) -> Column:
    """All blocks in canonical order behind the start token."""
    return F.concat(F.array(F.lit(START)), address_block(src, True), address_block(dst, False), rtt_block(ms), time_block(seconds, previous))


def block_order(seed: Column, blocks: Column) -> Column:
    """Order of so many blocks: a shuffle by the Mersenne Twister from the seed, as Python's random module makes it. The generator
    has no built-in form; rows come in Arrow batches."""

    @F.pandas_udf("array<int>")
    def order(seeds: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for seed, n in zip(seeds, counts):
            x = list(range(n))
            random.Random(int(seed)).shuffle(x)
            out.append(x)
        return pd.Series(out)

    return order(seed, blocks)


def shuffled_measurement(src: Column, dst: Column, ms: Column, seconds: Column, previous: Column, version: Column, with_time: bool = True) -> Column:
    """The start token and the blocks of a measurement in an order that addresses and time decide; null addresses are empty."""
    blocks = [merged_address(src, version, True), merged_address(dst, version, False), rtt_block(ms)]
    blocks += [time_block(seconds, previous)] if with_time else []
    order = block_order(shuffle_seed(src, dst, seconds), F.lit(len(blocks)))
    every = F.array(*blocks)
    return F.concat(F.array(F.lit(START)), F.flatten(F.transform(order, lambda i: F.get(every, i))))


def valid_tokens(tokens: Column) -> Column:
    return F.forall(tokens, lambda t: t.between(0, VOCABULARY - 1))
