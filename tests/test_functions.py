"""Globs, endpoints, tokens, digests, codecs and frames against tables of cases."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from driftline.functions import digests, expr, frames, globs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("include", "exclude", "path", "kept"),
    [
        (["**/*.txt"], ["**/secret*.txt"], "notes/readme.txt", True), (["**/*.txt"], ["**/secret*.txt"], "notes/secret.txt", True), (["**/*.txt"], ["**/secret*.txt"], "notes/image.png", False),
        ([], ["*.tmp"], "root/a.tmp", False), ([], ["*.tmp"], "a.tmp", False), ([], ["*.tmp"], "a.txt", True), ([], ["cache/"], "cache/data.bin", False), ([], ["cache/"], "other/cache/data.bin", True),
        (["docs/**"], [], "docs/readme.md", True), (["docs/**"], [], "src/main.rs", False), ([], ["a/[!b]*/x.{js,ts}"], "a/cd/x.ts", False), ([], ["a/[!b]*/x.{js,ts}"], "a/bd/x.ts", True),
    ],
)
def test_globs(spark, include, exclude, path, kept):
    assert one(spark, globs.allows(F.col("p"), include, exclude), p=path) is kept


def test_patterns():
    assert [globs.normalized(p) for p in (" ./a ", "\\b\\c", "d/", "/e")] == ["**/a", "b/c", "d/**", "**/e"]
    with pytest.raises(ValueError):
        globs.normalized(" ./ ")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("/data/in", ("local", None, None, None, "/data/in")), ("C:/tmp", ("local", None, None, None, "C:/tmp")), ("host:dir/x", ("ssh", None, "host", None, "dir/x")), ("user@host.org:/srv", ("ssh", "user", "host.org", None, "/srv")),
        ("ssh://u@h:22/p/q", ("ssh", "u", "h", 22, "/p/q")), ("sync://h:7000/data", ("quic", None, "h", 7000, "/data")), ("a/b:c", ("local", None, None, None, "a/b:c")), (":x", ("local", None, None, None, ":x")),
    ],
)
def test_endpoints(spark, text, want):
    assert tuple(one(spark, expr.endpoint(F.col("t")), t=text))[:5] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("sync://host", "missing path"), ("sync://host/", "remote path is empty"), ("ssh://@h/p", "remote user is empty"), ("ssh://u@/p", "remote host is empty"), ("ssh://h:99999/p", "invalid remote port"), ("ssh://h:x/p", "invalid remote port"),
        ("@h:d", "remote user is empty"), ("host:", ("local", None, None, None, "host:")), ("u@h:d", ("ssh", "u", "h", None, "d")), ("1:d", ("ssh", None, "1", None, "d")), ("ssh://u@a:b:c/p", ("ssh", "u", "a:b:c", None, "/p")),
    ],
)
def test_endpoint_traps(spark, text, want):
    got = tuple(one(spark, expr.endpoint(F.col("t")), t=text))
    assert got == ((None,) * 5 + (want,) if isinstance(want, str) else (*want, None))


def test_transport(spark):
    got = [one(spark, expr.transport(F.lit(a), F.lit(b))) for a, b in (("auto", "quic"), ("auto", "ssh"), ("auto", "local"), ("ssh", "local"), ("local", "quic"), ("tcp", "ssh"))]
    assert got == ["quic", "ssh", "local", "ssh", "local", None]


def test_tokens(spark):
    rows = [("qc:5:-7", (5, -7)), ("qc:5", None), ("qc:99999999999999999999:1", None), ("qc:a:1", None), ("x:1:2", None), ("qc:1:2:3", None)]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(expr.parsed_token(F.col("t")).alias("x")).collect()
    assert [None if r["x"] is None else tuple(r["x"]) for r in got] == [w for _, w in rows]


def test_sizes(spark):
    rows = [(0, 0, "0 B"), (4095, 1, "4.00 KiB"), (4096, 1, "4.00 KiB"), (4097, 2, "4.00 KiB"), (1152, 1, "1.12 KiB"), (3 << 30, 786432, "3.00 GiB")]
    df = spark.createDataFrame([(n,) for n, *_ in rows], "n long")
    got = df.select(expr.total_chunks(F.col("n"), 4096).alias("c"), expr.human_bytes(F.col("n")).alias("h")).collect()
    assert [(r["c"], r["h"]) for r in got] == [(c, h) for _, c, h in rows]
    assert one(spark, expr.saturating_add(F.lit((1 << 63) - 1), F.lit(5).cast("long"))) == (1 << 63) - 1


def test_prefixes(spark):
    allowed = lambda p, path: one(spark, expr.prefix_allowed(F.array(*map(F.lit, p)), F.lit(path)))
    assert allowed(["team-a"], "team-a/x") and allowed(["team-a"], "team-a") and not allowed(["team-a"], "team-ab/x") and allowed(["/"], "any")
    of = lambda *p: one(spark, expr.normalized_prefixes(F.array(*map(F.lit, p)).cast("array<string>")))
    assert of(" /a/b/ ", "a/b") == ["a/b"] and of() == ["/"] and of("a", "", "../x") == ["/"]
    assert of("../x") is None and of("a", "c/../d", "/") is None and of("///") is None
    assert one(spark, expr.prefix_allowed(expr.normalized_prefixes(F.array(F.lit("../x"))), F.lit("any"))) is False
    assert one(spark, expr.normalized_prefixes(F.array(F.lit("a"), F.lit("")))) == ["/"]


def test_bandwidth_and_rates(spark):
    got = [one(spark, expr.bandwidth_kib(F.lit(t))) for t in ("512", "3k", " 2M ", "1g", "", "x", "10 k", "k", "1 0", "9223372036854775807g", "18446744073709551616")]
    assert got == [512, 3, 2048, 1048576, None, None, 10, None, None, (1 << 63) - 1, None]
    assert one(spark, expr.rate(F.lit(0), F.lit(1.0))) == 0 and one(spark, expr.ratio_text(F.lit(1.0), F.lit(0.0))) == "inf"


def plain_blake3(data):
    """The published algorithm, word by word."""
    mask = 0xFFFFFFFF

    def compress(cv, block, counter, length, flags):
        m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
        v = [*cv, *digests.IV[:4], counter & mask, counter >> 32, length, flags]
        for _ in range(7):
            for k, (a, b, c, d) in enumerate(digests.ROUNDS):
                for x, s, t in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                    v[a] = (v[a] + v[b] + x) & mask
                    v[d] = ((v[d] ^ v[a]) >> s | (v[d] ^ v[a]) << 32 - s) & mask
                    v[c] = (v[c] + v[d]) & mask
                    v[b] = ((v[b] ^ v[c]) >> t | (v[b] ^ v[c]) << 32 - t) & mask
            m = [m[i] for i in digests.PERMUTATION]
        return [v[i] ^ v[i + 8] for i in range(8)]

    def tree(part, first, root):
        if len(part) <= 1024:
            cv, n = digests.IV, max(1, -(-len(part) // 64))
            for k in range(n):
                block = part[64 * k : 64 * k + 64]
                cv = compress(cv, block, first, len(block), (k == 0) * 1 | (k == n - 1) * (2 | root))
            return cv
        left = 1 << ((-(-len(part) // 1024) - 1).bit_length() - 1)
        both = [*tree(part[: 1024 * left], first, 0), *tree(part[1024 * left :], first + left, 0)]
        return compress(digests.IV, struct.pack("<16I", *both), 0, 64, 4 | root)

    return struct.pack("<8I", *tree(data, 0, 8))


def test_blake3_of_many_contents():
    contents = [bytes((i * n) % 253 for i in range(n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3073, 5000, 7 * 1024, 8193, 31_745)]
    assert digests.blake3_many(contents) == [plain_blake3(c) for c in contents] and digests.blake3_many([]) == []


def test_blake3_vectors():
    # published test vectors: input bytes 0, 1, ..., 250, 0, ... of several lengths
    data = bytes(i % 251 for i in range(5000))
    assert digests.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert digests.blake3(data[:1]).hex() == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert digests.blake3(data[:1025]).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    assert digests.blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


def test_digests_and_codec(spark):
    data = b"abc" * 500
    df = spark.createDataFrame([(data,), (b"x",)], "d binary")
    z = df.select("d", digests.digest(F.col("d"), "blake3").alias("b"), digests.digest(F.col("d")).alias("s"), digests.compressed(F.col("d"), 3).alias("z"))
    back = z.select("*", digests.decoded(F.col("z.data"), F.col("z.compressed"), F.octet_length("d").cast("long")).alias("raw")).collect()
    assert [bytes(r["raw"]) for r in back] == [data, b"x"] and [r["z"]["compressed"] for r in back] == [True, False]
    assert back[0]["s"] == hashlib.sha256(data).hexdigest() and back[0]["b"] == digests.blake3(data).hex()


def test_frames(spark):
    good = frames.encoded(F.lit(b"head"), F.lit(b"body"))
    assert one(spark, frames.decoded(good)["payload"]) == bytearray(b"body")
    for at, why in ((0, "magic"), (5, "protocol"), (6, "codec"), (7, "endianness"), (15, "length")):
        raw = bytearray(one(spark, good))
        raw[at] ^= 0x55
        assert one(spark, frames.decoded(F.lit(bytes(raw)))["error"]) == why
    assert one(spark, frames.decoded(F.lit(b"SPS1"))["error"]) == "short prefix"
