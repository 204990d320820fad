"""Full-text search: lexeme vectors, boolean queries, matching and ranking, as Arrow-batched functions.

A text vector is text like ``'brown':3 'fox':4``: quoted lexemes in byte order, with positions.
Configurations: simple (lower case) and english (stop words and the Porter2 stemmer).
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .udfs import bound

# Limits, stop words, rank weights.
MAX_POSITION, MAX_POSITIONS = 16_383, 256
_POSITIONS = tuple(map(str, range(1, MAX_POSITION)))  # those that one token has; all further tokens have the last
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}
MAX_WORDS, LONG_WORD = 200_000, 64  # words whose lexemes a worker keeps twice over, and how long they are at most

_TOKEN = re.compile(r"[^\W_]+")
_V = "aeiouy"
_VOWEL, _PAST_VOWEL = re.compile("[aeiouy]"), re.compile("[aeiouy][^aeiouy]")
_INITIAL_Y = re.compile("(^|(?<=[aeiouy]))y")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_ENDS2, _ENDS3 = (tuple(s for s, _ in step) for step in (_STEP2, _STEP3))


def _region(w: str, start: int) -> int:
    """Behind the first non-vowel that follows a vowel, from start."""
    m = _PAST_VOWEL.search(w, start)
    return m.end() if m else len(w)


def _short(w: str) -> bool:
    """Whether w ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


def stem(w: str) -> str:
    """The Porter2 (English) stem of a lower-case word."""
    if len(w) <= 2 or not w.isascii():
        return w
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    w = w.removeprefix("'")
    if "y" in w:
        w = _INITIAL_Y.sub("Y", w)
    r1 = (6 if w[0] == "c" else 5) if w.startswith(("gener", "commun", "arsen")) else _region(w, 0)
    r2 = _region(w, r1)
    if "'" in w:
        for s in ("'s'", "'s", "'"):
            if w.endswith(s):
                w = w[: -len(s)]
                break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w, 0, len(w) - 2):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(("ly", "ed", "ing")) else ():
        if w.endswith(s):
            if s.startswith("eed"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif _VOWEL.search(w, 0, len(w) - len(s)):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif r1 >= len(w) and _short(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for s, new in _STEP2 if w.endswith(_ENDS2) else ():
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ogi" or w[at - 1 : at] == "l") and (s != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + new
            break
    # 3
    for s, new in _STEP3 if w.endswith(_ENDS3) else ():
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ative" or at >= r2):
                w = w[:at] + new
            break
    # 4
    for s in _STEP4 if w.endswith(_STEP4) else ():
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1]):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w.endswith("ll"):
        w = w[:-1]
    return w.replace("Y", "y")


def _config(name: str) -> str:
    if name.lower() not in ("simple", "english"):
        raise ValueError(f"text search configuration {name!r} does not exist")
    return name.lower()


class _Lexemes(dict):
    """The lexeme of a token, None for a stop word; kept by token, for most tokens come again.

    When full it starts afresh, and takes what is asked for again from the words before.
    """

    def __init__(self, config: str):
        self.english, self.before = config == "english", {}

    def __missing__(self, token: str) -> str | None:
        if token in self.before:
            w = self.before[token]
        else:
            w = token.lower()
            if self.english and (w.isalpha() or not any(c.isdigit() for c in w)):
                w = None if w in STOP else stem(w)
        if len(token) <= LONG_WORD:
            if len(self) >= MAX_WORDS:
                self.before = dict(self)
                self.clear()
            self[token] = w
        return w


@lru_cache
def _lexemes(config: str) -> _Lexemes:
    return _Lexemes(config)


def _tokens(text: str, config: str) -> list[str | None]:
    """The lexeme of each token in order, None in the place of a stop word."""
    return list(map(_lexemes(config).__getitem__, _TOKEN.findall(text)))


def lexemes(text: str, config: str) -> list[tuple[str, int]]:
    """(lexeme, position) of each token; stop words take a position and are left out."""
    return [(w, min(k, MAX_POSITION)) for k, w in enumerate(_tokens(text, config), 1) if w is not None]


def vector_text(entries: dict[str, list[str]]) -> str:
    quote = lambda w: w.replace("'", "''") if "'" in w else w
    return " ".join([f"'{quote(w)}'" + (":" + ",".join(p) if (p := entries[w]) else "") for w in sorted(entries)])


def make_vector(text: str, config: str = "english") -> str:
    at: dict[str, list[str]] = defaultdict(list)
    words = _tokens(text, config)
    for w, p in zip(words, _POSITIONS):
        at[w].append(p)
    for w in set(words[len(_POSITIONS) :]):
        at[w].append(str(MAX_POSITION))
    at.pop(None, None)
    for own in at.values():
        del own[MAX_POSITIONS:]
    return vector_text(at)


def parse_vector(v: str) -> dict[str, list[str]]:
    return {m[1].replace("''", "'"): (m[2].split(",") if m[2] else []) for m in re.finditer(r"'((?:[^']|'')*)'(?::([\dA-D,]+))?", v)}


# Queries are nested tuples: ("lexeme", w), ("!", q), ("&", a, b), ("|", a, b).


def parse_query(text: str, config: str | None = "english"):
    """A query tree, or None if nothing is left; config None takes lexemes as they are."""
    tokens = re.findall(r"'(?:[^']|'')*'|[&|!()]|[^\s&|!()']+", text)
    at = 0

    def take(want: str) -> bool:
        nonlocal at
        if at < len(tokens) and tokens[at] == want:
            at += 1
            return True
        return False

    def atom():
        nonlocal at
        if take("!"):
            q = atom()
            return None if q is None else ("!", q)
        if take("("):
            q = either()
            if not take(")"):
                raise ValueError(f"syntax error in tsquery: {text!r}")
            return q
        if at >= len(tokens) or tokens[at] in "&|)":
            raise ValueError(f"syntax error in tsquery: {text!r}")
        w = tokens[at]
        at += 1
        w = w[1:-1].replace("''", "'") if w[0] == "'" else w
        if config is None:
            return ("lexeme", w)
        if ":" in w or "<" in w:
            raise ValueError(f"unsupported tsquery form: {text!r}")
        parts = [("lexeme", x) for x, _ in lexemes(w, config)]
        return join("&", parts)

    def join(op, parts):
        parts = [p for p in parts if p is not None]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = (op, out, p)
        return out

    def both():
        parts = [atom()]
        while take("&"):
            parts.append(atom())
        return join("&", parts)

    def either():
        parts = [both()]
        while take("|"):
            parts.append(both())
        return join("|", parts)

    if not tokens:
        return None
    q = either()
    if at != len(tokens):
        raise ValueError(f"syntax error in tsquery: {text!r}")
    return q


_BIND = {"|": 1, "&": 2, "!": 3, "lexeme": 4}


def query_text(q, outer: int = 0) -> str:
    if q is None:
        return ""
    if q[0] == "lexeme":
        return "'" + q[1].replace("'", "''") + "'"
    mine = _BIND[q[0]]
    s = "!" + query_text(q[1], mine) if q[0] == "!" else f"{query_text(q[1], mine)} {q[0]} {query_text(q[2], mine)}"
    return f"( {s} )" if mine < outer else s


def matches(vector: dict, q) -> bool:
    if q is None:
        return False
    if q[0] == "lexeme":
        return q[1] in vector
    if q[0] == "!":
        return not matches(vector, q[1])
    a, b = matches(vector, q[1]), matches(vector, q[2])
    return a and b if q[0] == "&" else a or b


def _operands(q) -> list[str]:
    return [q[1]] if q[0] == "lexeme" else [w for x in q[1:] for w in _operands(x)]


def _positions(entry: list[str]) -> list[tuple[int, float]]:
    return [(int(p.rstrip("ABCD")), WEIGHTS[p[-1] if p[-1] in "ABCD" else "D"]) for p in entry] or [(MAX_POSITION, WEIGHTS["D"])]


def rank(vector: dict, q, method: int = 0) -> float:
    """Term-frequency relevance (single precision)."""
    if q is None or not vector:
        return 0.0
    words = sorted(set(_operands(q)))
    found = [_positions(vector[w]) for w in words if w in vector]
    f = np.float32
    if q[0] == "&" and len(words) > 1:
        res = -1.0
        for k, a in enumerate(found):
            for b in found[:k]:
                for p, x in a:
                    for r, y in b:
                        d = abs(p - r) or (MAX_POSITION if MAX_POSITION in (p, r) else 0)
                        if d:
                            near = 1e-30 if d > 100 else 1.0 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))
                            cur = math.sqrt(x * y * near)
                            res = cur if res < 0 else 1.0 - (1.0 - res) * (1.0 - cur)
    else:
        res = 0.0
        for pos in found:
            total = sum(w / ((k + 1) ** 2) for k, (_, w) in enumerate(pos))
            top, at = max((w, -k) for k, (_, w) in enumerate(pos))
            res += (top + total - top / ((1 - at) ** 2)) / 1.64493406685
        res /= len(words)
    if res < 0:
        res = 1e-20
    length = sum(max(len(p), 1) for p in vector.values())
    if method & 1:
        res /= math.log(length + 1) / math.log(2)
    if method & 2 and length:
        res /= length
    if method & 8 and vector:
        res /= len(vector)
    if method & 16 and vector:
        res /= math.log(len(vector) + 1) / math.log(2)
    if method & 32:
        res /= res + 1
    return float(f(res))


def _batch(f, kind: str):
    @F.pandas_udf(kind)
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*cols)], dtype=object)

    return bound(run)


def to_tsvector(text, config: str = "english"):
    c = _config(config)
    return _batch(lambda s: make_vector(s, c), "string")(text)


def to_tsquery(text, config: str = "english"):
    c = _config(config)
    return _batch(lambda s: query_text(parse_query(s, c)), "string")(text)


def plainto_tsquery(text, config: str = "english"):
    c = _config(config)
    return _batch(lambda s: " & ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(w for w, _ in lexemes(s, c))), "string")(text)


def ts_match(vector, query):
    """vector @@ query."""
    return _batch(lambda v, q: matches(parse_vector(v), parse_query(q, None)), "boolean")(vector, query)


def ts_rank(vector, query, method: int = 0):
    return _batch(lambda v, q: rank(parse_vector(v), parse_query(q, None), method), "float")(vector, query)


def _nodes(q) -> int:
    return 0 if q is None else 1 if q[0] == "lexeme" else 1 + sum(_nodes(x) for x in q[1:])


def numnode(query):
    return _batch(lambda q: _nodes(parse_query(q, None)), "int")(query)


def strip(vector):
    return _batch(lambda v: vector_text({w: [] for w in parse_vector(v)}), "string")(vector)


def setweight(vector, weight: str):
    w = weight.upper()
    if w not in WEIGHTS:
        raise ValueError(f"unrecognized weight: {weight}")
    mark = "" if w == "D" else w
    return _batch(lambda v: vector_text({k: [p.rstrip("ABCD") + mark for p in ps] for k, ps in parse_vector(v).items()}), "string")(vector)
