"""Text, pattern and hash functions of the dialect as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*cols: Column) -> Column:
    """CONCAT: NULLs are skipped (the || operator is F.concat)."""
    return F.concat_ws("", *[c.cast("string") for c in cols])


def left(s: Column, n: int) -> Column:
    """LEFT: a negative n leaves out the last -n characters."""
    return s.substr(F.lit(1), F.lit(n) if n >= 0 else F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    """RIGHT: a negative n leaves out the first -n characters."""
    size = F.length(s)
    take = F.least(F.lit(n), size) if n >= 0 else F.greatest(size + n, F.lit(0))
    return s.substr(size - take + 1, take)


def substring(s: Column, start: int, length: int | None = None) -> Column:
    """SUBSTRING with SQL's window: positions before 1 use up the length."""
    if length is not None and length < 0:
        raise ValueError("negative substring length not allowed")
    first = max(start, 1)
    n = F.length(s) if length is None else F.lit(max(start + length - first, 0))
    return s.substr(F.lit(first), n)


def split_part(s: Column, sep: str, n: int) -> Column:
    """SPLIT_PART: '' past the end; a negative n counts from the end."""
    if n == 0:
        raise ValueError("field position must not be zero")
    return F.split_part(s, F.lit(sep), F.lit(n)) if sep else F.when(F.lit(abs(n) == 1), s).otherwise("")


def initcap(s: Column) -> Column:
    """INITCAP with any non-alphanumeric character as a word boundary."""
    chars = F.split(F.lower(s), "")
    prev = F.concat(F.array(F.lit(" ")), chars)
    return F.array_join(F.zip_with(chars, F.slice(prev, 1, F.size(chars)), lambda c, p: F.when(p.rlike(r"[\p{L}\p{N}]"), c).otherwise(F.upper(c))), "")


def strpos(s: Column, sub: str) -> Column:
    return F.locate(sub, s) if sub else F.when(s.isNotNull(), 1)


def overlay(s: Column, new: str, start: int, length: int | None = None) -> Column:
    return F.overlay(s, F.lit(new), F.lit(start), F.lit(len(new) if length is None else length))


def quote_literal(s: Column) -> Column:
    body = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.concat(F.when(F.contains(s, F.lit("\\")), F.lit("E'")).otherwise(F.lit("'")), body, F.lit("'"))


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def quote_ident(s: Column) -> Column:
    return F.when(s.rlike(r"^[a-z_][a-z0-9_$]*$"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def format_(template: str, *args: Column) -> Column:
    """FORMAT with %s, %I, %L and %%."""
    parts, at, i = [], 0, 0
    while at < len(template):
        j = template.find("%", at)
        if j < 0:
            parts.append(F.lit(template[at:]))
            break
        if j > at:
            parts.append(F.lit(template[at:j]))
        kind = template[j + 1 : j + 2]
        if kind == "%":
            parts.append(F.lit("%"))
        elif kind in ("s", "I", "L") and kind:
            if i >= len(args):
                raise ValueError("too few arguments for format()")
            a = args[i].cast("string")
            parts.append({"s": F.coalesce(a, F.lit("")), "I": quote_ident(a), "L": quote_nullable(a)}[kind])
            i += 1
        else:
            raise ValueError(f"unrecognized format() type specifier {kind!r}")
        at = j + 2
    return F.concat(*parts) if parts else F.lit("")


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n.cast("bigint")))


def encode(b: Column, kind: str) -> Column:
    if kind == "hex":
        return F.lower(F.hex(b))
    if kind == "base64":
        return F.base64(b)
    raise ValueError(f"unrecognized encoding: {kind}")


def decode(s: Column, kind: str) -> Column:
    if kind == "hex":
        return F.unhex(s)
    if kind == "base64":
        return F.unbase64(s)
    raise ValueError(f"unrecognized encoding: {kind}")


def sha224(s: Column) -> Column:
    return F.sha2(s, 224)


# Regular expressions.  Patterns are Java's; replacements use \1 .. \9 and \& as the dialect does.


def _flags(pattern: str, flags: str) -> str:
    on = "".join(f for f in "imsx" if f in flags.replace("n", "m"))
    return f"(?{on}){pattern}" if on else pattern


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def regexp_replace(s: Column, pattern: str, new: str, flags: str = "") -> Column:
    """The first match, or every match with the flag g."""
    p = _flags(pattern, flags)
    java = new.replace("$", r"\$").replace(r"\&", "$0")
    for k in range(1, 10):
        java = java.replace(f"\\{k}", f"${k}")
    if "g" in flags:
        return F.regexp_replace(s, p, java)
    # everything after the first match is put behind it
    found = F.regexp_instr(s, F.lit(p))
    hit = F.regexp_substr(s, F.lit(p))
    done = F.regexp_replace(hit, p, java)
    return F.when(found == 0, s).otherwise(F.concat(s.substr(F.lit(1), found - 1), done, s.substr(found + F.length(hit), F.length(s))))


def regexp_match(s: Column, pattern: str, flags: str = "") -> Column:
    p = _flags(pattern, flags)
    n = _groups(pattern)
    groups = [F.regexp_extract(s, p, k) for k in (range(1, n + 1) if n else [0])]
    return F.when(s.rlike(p), F.array(*groups))


def regexp_matches_all(s: Column, pattern: str, flags: str = "") -> Column:
    """array<array<string>> of every match's groups (the whole match without groups)."""
    p = _flags(pattern, flags)
    n = _groups(pattern)
    every = [F.regexp_extract_all(s, F.lit(p), F.lit(k)) for k in (range(1, n + 1) if n else [0])]
    return F.transform(every[0], lambda _, i: F.array(*[F.get(e, i) for e in every]))


def regexp_like(s: Column, pattern: str, flags: str = "") -> Column:
    return s.rlike(_flags(pattern, flags))


def regexp_count(s: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(s, F.lit(_flags(pattern, flags)))


def regexp_instr(s: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_instr(s, F.lit(_flags(pattern, flags)))


def regexp_substr(s: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_substr(s, F.lit(_flags(pattern, flags)))


def regexp_split_to_array(s: Column, pattern: str, flags: str = "") -> Column:
    return F.split(s, _flags(pattern, flags), -1)


def similar_to(s: Column, pattern: str) -> Column:
    return s.rlike(similar_pattern(pattern))


def similar_pattern(pattern: str) -> str:
    """A SIMILAR TO pattern as a regular expression: % and _ as in LIKE, over the whole text."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append("\\" + pattern[i + 1])
            i += 2
            continue
        out.append({"%": "(?s:.*)", "_": "(?s:.)", ".": r"\.", "^": r"\^", "$": r"\$"}.get(c, c))
        i += 1
    return "^(?:" + "".join(out) + ")$"


def regex_match(s: Column, pattern: str, insensitive: bool = False, negated: bool = False) -> Column:
    """The ~, ~*, !~ and !~* operators."""
    out = s.rlike(("(?i)" if insensitive else "") + pattern)
    return ~out if negated else out


def encrypt(s: Column, key: Column) -> Column:
    """Hex of AES-GCM under the SHA-256 of the key."""
    return F.lower(F.hex(F.aes_encrypt(F.encode(s, "UTF-8"), F.unhex(F.sha2(key, 256)))))


def decrypt(s: Column, key: Column) -> Column:
    return F.decode(F.aes_decrypt(F.unhex(s), F.unhex(F.sha2(key, 256))), "UTF-8")
