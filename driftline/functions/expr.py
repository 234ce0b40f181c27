"""Column functions on paths, tokens, sizes and endpoints. Built-in expressions only: no Python in any row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1


def saturating_add(a: Column, b: Column) -> Column:
    """a + b, or the largest long where that overflows."""
    return F.coalesce(F.try_add(a, b), F.lit(LONG_MAX))


def quick_token(size: Column, mtime: Column) -> Column:
    """Identity without content: ``qc:size:mtime``."""
    return F.concat(F.lit("qc:"), size.cast("string"), F.lit(":"), mtime.cast("string"))


def is_quick_token(token: Column) -> Column:
    return F.startswith(token, F.lit("qc:"))


def parsed_token(token: Column) -> Column:
    """struct(size, mtime) of a quick token; null if it is not one, or a number is malformed or out of range."""
    shape = r"^qc:\+?(\d+):([+-]?\d+)$"
    size = F.regexp_extract(token, shape, 1).try_cast("long")
    mtime = F.regexp_extract(token, shape, 2).try_cast("long")
    return F.when(size.isNotNull() & mtime.isNotNull(), F.struct(size.alias("size"), mtime.alias("mtime")))


def total_chunks(size: Column, chunk: int | Column) -> Column:
    """Chunks of a file: 0 if it is empty, else its size over the chunk size, rounded up."""
    c = F.greatest(F.lit(chunk) if isinstance(chunk, int) else chunk, F.lit(1)).cast("long")
    return F.when(size == 0, F.lit(0)).otherwise(_div(size + c - 1, c)).cast("long")


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient of non-negative longs, without a detour over doubles."""
    return F.call_function("div", a, b).cast("long")


def partial_name(path: Column) -> Column:
    """Where an incomplete file is kept: ``.part`` after the name; a leading-dot name without extension keeps its dot."""
    return F.concat(path, F.lit(".part"))


def relative_path(root: Column, path: Column) -> Column:
    """``path`` below ``root`` with '/' between its parts; null outside the root or at the root itself."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    rest = F.regexp_replace(F.substring(path, F.length(base) + 1, F.lit(1 << 30)), "/+", "/")
    return F.when(F.startswith(path, base) & (rest != ""), rest)


def sanitized(path: Column) -> Column:
    """A safe relative path: '.' and empty segments go; null if empty, absolute, or with a '..' segment."""
    parts = F.split(path, "/")
    kept = F.filter(parts, lambda x: ~x.isin("", "."))
    bad = F.startswith(path, F.lit("/")) | F.exists(parts, lambda x: x == "..") | (F.size(kept) == 0)
    return F.when(~bad, F.array_join(kept, "/"))


def parent(path: Column) -> Column:
    """The directory of a path; '' at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def by_components(path: Column) -> Column:
    """Sort key by path components, in which a/b comes before a.txt."""
    return F.split(path, "/")


def _two_decimals(x: Column) -> Column:
    """x with two decimals; ties go to the even digit, where Java's own format would round up."""
    return F.format_string("%.2f", F.bround(x, 2))


def human_bytes(n: Column) -> Column:
    """Bytes in steps of 1024 up to TiB, two decimals above B."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**power, F.concat(_two_decimals(n.cast("double") / float(1024**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def bandwidth_kib(literal: Column) -> Column:
    """KiB per second of a limit such as 512, 512k, 2 m or 1g; null if it is malformed, the largest long where it overflows."""
    shape = r"^\s*\+?(\d+)\s*([kKmMgG])\s*$|^\s*\+?(\d+)\s*$"
    digits = F.concat(F.regexp_extract(literal, shape, 1), F.regexp_extract(literal, shape, 3))
    unit = F.lower(F.regexp_extract(literal, shape, 2))
    number = digits.try_cast("decimal(38,0)")
    times = F.when(unit == "m", 1024).when(unit == "g", 1024 * 1024).otherwise(1)
    least = F.least((number * times).cast("decimal(38,0)"), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    return F.when(number <= F.lit(str((1 << 64) - 1)).cast("decimal(38,0)"), least)


def megabits_per_second(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 1e-12, n.cast("double") * 8.0 / seconds / 1e6).otherwise(F.lit(0.0))


def rate(items: Column, seconds: Column) -> Column:
    """Items per second; without time, the items themselves."""
    return F.when(items == 0, F.lit(0.0)).when(seconds > 1e-12, items.cast("double") / seconds).otherwise(items.cast("double"))


def ratio_text(a: Column, b: Column) -> Column:
    """a/b with two decimals and an x, or inf."""
    return F.when(b == 0, F.lit("inf")).otherwise(F.concat(_two_decimals(a / b), F.lit("x")))


def write_concurrency(total: Column, files: Column) -> Column:
    """How many files to write at once, by their mean size."""
    mean = _div(total, F.greatest(files, F.lit(1)).cast("long"))
    return F.when(files == 0, 16).when(mean <= 8 << 10, 24).when(mean <= 64 << 10, 48).when(mean <= 512 << 10, 64).otherwise(96).cast("long")


def prefix_allowed(prefixes: Column, path: Column) -> Column:
    """Whether a path is a listed prefix or lies below one; '/' allows all, and no list (null) nothing."""
    return F.coalesce(F.exists(prefixes, lambda p: (p == "/") | (path == p) | F.startswith(path, F.concat(p, F.lit("/")))), F.lit(False))


def normalized_prefix(prefix: Column) -> Column:
    """A prefix as it is stored: '' and '/' allow all, slashes around go; null if it is unsafe."""
    text = F.trim(prefix)
    return F.when(text.isin("", "/"), F.lit("/")).otherwise(sanitized(F.regexp_replace(text, "^/+", "")))


def normalized_prefixes(prefixes: Column) -> Column:
    """Distinct normalised prefixes in their order; a '/' makes it the only one, and so does an empty list.

    An unsafe or null prefix before any '/' refuses the whole list: the result is null, which
    allows nothing (``prefix_allowed``)."""
    done = F.transform(prefixes, normalized_prefix)
    slash = F.array_position(done, F.lit("/"))
    bad = F.array_position(F.transform(done, lambda p: p.isNull()), F.lit(True))
    return (
        F.when((F.size(prefixes) == 0) | (slash > 0) & ((bad == 0) | (slash < bad)), F.array(F.lit("/")))
        .when(bad == 0, F.array_distinct(done))
    )


def profile_component(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9\-_.]", "_")


def client_component(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9\-_]", "-")


def shell_quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))


def fingerprint(certificate: Column) -> Column:
    return F.sha2(certificate, 256)


def endpoint(text: Column, scheme: str = "sync") -> Column:
    """struct(kind, user, host, port, path, error): quic for ``scheme://``, ssh for ``ssh://`` and host:path, else local.

    A remote endpoint that is malformed has an error and nothing else: no path (or '/' alone) after
    ``scheme://``, an empty user or host, a port that is no number up to 65535."""
    is_quic, is_ssh = F.startswith(text, F.lit(f"{scheme}://")), F.startswith(text, F.lit("ssh://"))
    # host:path, unless absolute or like a drive (one letter and a colon)
    is_scp = ~F.startswith(text, F.lit("/")) & ~text.rlike("^[A-Za-z]:") & text.rlike(r"(?s)^[^:/]+:.+$")
    whole = F.struct(F.when(is_quic, "quic").when(is_ssh | is_scp, "ssh").otherwise("local").alias("kind"), (is_quic | is_ssh).alias("url"), F.regexp_replace(text, rf"^(?:{scheme}|ssh)://", "").alias("rest"))

    def cut(w: Column) -> Column:
        """The peer and the path: a URL's from its first '/', host:path's after its first ':'."""
        rest, at = w["rest"], F.instr(w["rest"], F.when(w["url"], "/").otherwise(":"))
        peer = F.when(w["kind"] != "local", F.when(at > 0, F.substring(rest, F.lit(1), at - 1)).otherwise(rest))
        path = F.when(w["kind"] == "local", rest).when(at > 0, F.substring(rest, F.when(w["url"], at).otherwise(at + 1), F.length(rest)))
        return F.struct(w["kind"].alias("kind"), peer.alias("peer"), path.alias("path"), F.instr(peer, "@").alias("at"), w["url"].alias("url"))

    def peered(c: Column) -> Column:
        place = F.substring(c["peer"], c["at"] + 1, F.length(c["peer"]))
        one_port = place.rlike("^[^:]*:[^:]*$")  # more colons are an address without a port
        port = F.when(one_port, F.regexp_replace(place, r"^[^:]*:\+?", "").try_cast("long"))
        host = F.when(one_port, F.regexp_replace(place, ":.*$", "")).otherwise(place)
        wrong = one_port & ~(place.rlike(r":\+?[0-9]+$") & F.coalesce(port.between(0, 65535), F.lit(False)))
        return F.struct(*(c[k].alias(k) for k in ("kind", "path", "at", "url", "peer")), place.alias("place"), host.alias("host"), port.alias("port"), wrong.alias("wrong"))

    def checked(p: Column) -> Column:
        error = (
            F.when(p["url"] & p["path"].isNull(), "missing path").when(p["at"] == 1, "remote user is empty").when(p["place"] == "", "remote host is empty")
            .when(p["wrong"], "invalid remote port").when(p["url"] & (p["path"] == "/"), "remote path is empty")
        )
        user = F.when(p["at"] > 0, F.substring(p["peer"], F.lit(1), p["at"] - 1))
        return F.struct(*(p[k].alias(k) for k in ("kind", "host", "port", "path")), user.alias("user"), error.alias("error"))

    def told(r: Column) -> Column:
        return F.struct(*(F.when(r["error"].isNull(), r[k]).alias(k) for k in ("kind", "user", "host", "port", "path")), r["error"].alias("error"))

    return _then(_then(_then(_then(whole, cut), peered), checked), told)


def _then(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value) with the value worked out once, however often it is used."""
    return F.transform(F.array(value), make)[0]


def transport(chosen: Column, kind: Column) -> Column:
    """The transport for an endpoint: local, ssh or quic as chosen, or with 'auto' what its kind says; null for any other word."""
    return F.when(chosen.isin("local", "ssh", "quic"), chosen).when(chosen == "auto", F.when(kind.isin("quic", "ssh"), kind).otherwise("local"))


def private_mode(mode: Column) -> Column:
    """Whether nobody but the owner has rights."""
    return mode.bitwiseAND(F.lit(0o077)) == 0


def permission_bits(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(0o7777))
