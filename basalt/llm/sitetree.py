"""Main-text extraction with site style trees.

The DOMs of one host are merged into a tree of presentation nodes (tag, classes, id).  A node's
presentation importance is the entropy of its child sequences over the host's pages; its content
importance is one minus the mean normalised entropy of its phrases, weighted by their length, over the
pages of all hosts: a phrase that many pages share says little.  Both are combined as in site style trees,
presentation counting the more, the more child sequences a node has.  Branches in which every node is of low
importance are removed from each page.  Names of elements and classes are a second input: what
they mark as a menu or an advert goes, and what they mark as the article stays unless nearly all of it repeats.
Copies of a page count once.  All counting is grouped aggregation with map-side combine; small
hosts lean on the tree of all hosts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

# Element names by their part in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav footer aside form header menu dialog search fieldset".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion teaser teasers banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies notice notices alert consent gdpr popup modal overlay newsletter subscribe subscription signup comment comments reply replies respond disqus share sharing social related recommended widget toolbar login search pagination pager skip".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}

GAMMA = 0.9
#: Branches below this importance are removed; inside an article only those that nearly all pages share.
THRESHOLD, INSIDE = 0.4, 0.15
#: Pages from which on a phrase says nothing at all (its entropy is normalised by their logarithm).
COMMON = 8
#: Bytes of removals up to which all of them are broadcast; beyond, each page is joined with its own.
REMOVAL_BYTES = 16 << 20
#: Pages that a host needs for its own tree to count fully, and at all for removal by entropy.
TRUST, LEAST = 20, 5
SPACE = re.compile(r"\s+")
#: Where a block's text is cut into phrases.
PHRASE = re.compile(r"[.!?;:](?:\s+|\Z)|\s*[|\u00b7\u2022\u00bb\u203a\u2014]\s*")


#: Markup: comments, elements whose content is no text (to their end tag), tags, declarations.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|textarea|iframe|select|svg|math|object|audio|video|canvas|button|datalist)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))""")


class _Page:
    """Blocks of text with the style path of each: tag.classes#id@role of every open block element."""

    def __init__(self, html: str):
        self.stack: list[tuple[str, str]] = []
        self.blocks: list[tuple[tuple[str, ...], str]] = []
        self.children: list[tuple[tuple[str, ...], str]] = []
        self.text: list[str] = []
        self.path: tuple[str, ...] = ()
        self.head = False
        end = 0
        for m in TOKEN.finditer(html):
            if m.start() > end and not self.head:
                self.text.append(html[end : m.start()])
            end = m.end()
            if tag := m[3]:
                tag = tag.lower()
                if m[2]:
                    self.close(tag)
                else:
                    self.open(tag, m[4])
        if end < len(html) and not self.head:
            self.text.append(html[end:])
        self.flush()

    def flush(self) -> None:
        if self.text:
            text = "".join(self.text)
            self.text = []
            text = " ".join(SPACE.split(unescape(text) if "&" in text else text)).strip()
            if text:
                self.blocks.append((self.path, text))

    def cut(self, k: int) -> None:
        del self.stack[k:]
        self.path = tuple(s for _, s in self.stack)

    def open(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag == "head":
            self.head = True
        elif tag == "body" or tag in BLOCKS:
            self.head = False
        if tag not in BLOCKS or tag == "body":
            return
        self.flush()
        while self.stack and self.stack[-1][0] == "p":
            self.cut(-1)
        if tag in CLOSES:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in SCOPE[tag]:
                    break
                if self.stack[k][0] in CLOSES[tag]:
                    self.cut(k)
                    break
        if tag in VOID:
            return
        label = tag
        if "=" in rest:
            a: dict[str, str] = {}
            for name, *values in ATTRIBUTE.findall(rest):
                a.setdefault(name.lower(), unescape("".join(values)).lower())
            label += "".join(f".{n}" for n in sorted({*a.get("class", "").split()})) + (f"#{a['id']}" if a.get("id") else "") + (f"@{a['role']}" if a.get("role") else "")
            label = label.replace("/", "_")
        self.children.append((self.path, label))
        self.stack.append((tag, label))
        self.path = (*self.path, label)

    def close(self, tag: str) -> None:
        if tag == "head":
            self.head = False
        if tag not in BLOCKS or tag == "body":
            return
        self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.cut(k)
                break


def parse(html: str | None) -> _Page:
    return _Page(html or "")


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


@lru_cache(100_000)
def _in_main(path: tuple[str, ...]) -> bool:
    return any(re.match(r"(article|main)\b", s) or s.endswith("@main") for s in path)


def prior(label: str, inside: bool) -> float:
    """What a node's names say: 0 noise, 1 nothing said.  Inside an article, its own header counts as text."""
    tag, *rest = re.split(r"[.#@]", label)
    if tag in NOISE_TAGS and not (inside and tag == "header"):
        return 0.0
    words = {w for r in rest for w in re.split(r"[-_]+", r)}
    if words & NOISE_WORDS and not (inside and words & NOISE_WORDS <= {"header", "banner"}) or words & NOISE_ROLES and not inside:
        return 0.0
    return 1.0


@lru_cache(100_000)
def _noise(path: tuple[str, ...]) -> bool:
    """Whether the names on the path alone make it noise."""
    return any(prior(path[k], _in_main(path[:k])) == 0 for k in range(len(path)))


def _main(page: _Page) -> bool:
    """Whether the page has text in an article or main element that is not itself noise, as a reader's comment is."""
    return any(_in_main(p) and not _noise(p) for p, _ in page.blocks)


def _signature(page: _Page) -> int:
    """Hash of the longest blocks, three or those that hold half of the page's text: copies of a page share it, whatever surrounds them."""
    texts = sorted({t for _, t in page.blocks}, key=lambda t: (-len(t), t))
    need, used = sum(map(len, texts)) / 2, []
    for t in texts:
        if need <= 0 or len(used) == 3:
            break
        used.append(t)
        need -= len(t)
    return phrase_hash("\n".join(used))


def phrase_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - 2**63


def phrases(text: str) -> dict[int, int]:
    """Hash and length of each phrase of a block."""
    return {phrase_hash(x): len(x) for x in PHRASE.split(text) if x}


def _found(pages: DataFrame) -> DataFrame:
    """(host, sig, page, found): signature and hash of each page, with the child sequences of its nodes and the
    phrases at their nodes, but for what names make noise.  A node's number is the hash of host and path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[tuple[str, int]] = set()
        for batch in batches:
            rows = []
            for url, html in zip(batch["url"], batch["html"]):
                page, host = parse(html), host_of(url)
                sig = _signature(page)
                if (host, sig) in known:  # of very many copies, a task hands on one
                    continue
                if len(known) >= 100_000:
                    known.clear()
                known.add((host, sig))
                below: dict[tuple, list[str]] = {}
                for up, label in page.children:
                    below.setdefault(up, []).append(label)
                    below.setdefault((*up, label), [])
                at: dict[tuple, dict[int, int]] = {}
                for path, text in page.blocks:
                    if path and not _noise(path):
                        at.setdefault(path, {}).update(phrases(text))
                number = lambda path: phrase_hash(f"{host}\n{'/'.join(path)}")  # noqa: E731, B023
                styles = [{"path": "/".join(path), "node": number(path), "feature": phrase_hash(" ".join(labels))} for path, labels in below.items() if path and not _noise(path)]
                uses = [{"node": number(path), "features": list(got), "sizes": list(got.values())} for path, got in at.items()]
                rows.append((host, sig, phrase_hash(html or ""), {"styles": styles, "uses": uses}))
            yield pd.DataFrame(rows, columns=["host", "sig", "page", "found"])

    found = "struct<styles: array<struct<path: string, node: bigint, feature: bigint>>, uses: array<struct<node: bigint, features: array<bigint>, sizes: array<int>>>>"
    return pages.select("url", "html").mapInPandas(run, f"host string, sig bigint, page bigint, found {found}")


def _in_article(path) -> Column:
    """The same as _in_main, for a path column."""
    return path.rlike(r"(^|/)(article|main)\b|@main(/|$)")


def low_importance(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, what) to remove: a path whose node and all below it are of low importance, or
    path/=hash for a phrase that at least half of the host's pages have at a node that stays."""
    scratch = Scratch(pages.sparkSession)
    # copies of a page count once on their host, and once in how many pages use a phrase
    once = _found(pages).repartition("sig").groupBy("sig", "host").agg(F.min_by("found", "page").alias("f"))
    once = scratch.put(once.select("host", "f.*", (F.row_number().over(Window.partitionBy("sig").orderBy("host")) == 1).cast("int").alias("lead")))
    styles = once.select("host", F.explode("styles").alias("s")).select("host", "s.*").groupBy("host", "path", "node", "feature").agg(F.count("*").alias("n"))
    styles = scratch.put(styles)
    uses = once.select("lead", F.explode("uses").alias("u")).select("lead", "u.node", F.explode(F.arrays_zip("u.features", "u.sizes")).alias("x"))
    uses = uses.select("node", F.col("x.features").alias("feature"), F.col("x.sizes").alias("size"), "lead")
    # phrases that stand once are summed by node; the others are counted, the common ones by AQE's splitting of the join
    known = uses.groupBy("feature").agg(F.sum("lead").alias("all"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    uses = uses.join(known, "feature", "left").withColumn("feature", F.when(F.col("all").isNotNull(), F.col("feature")))
    uses = uses.groupBy("node", "feature").agg(F.count("*").alias("n"), F.sum("size").alias("mass"), F.max("all").alias("all"))
    # a phrase that half of a host's pages have at a node is the host's own; the node is judged by the others
    have = styles.groupBy("host", "path", "node").agg(F.sum("n").alias("m"))
    fixed = F.col("feature").isNotNull() & (F.col("n") > 1) & (2 * F.col("n") >= F.col("m"))
    pages_with = F.when(F.col("feature").isNull(), 1).otherwise(F.greatest("all", "n"))
    uses = uses.join(have, "node").select("host", "path", "feature", "mass", pages_with.alias("all"), fixed.alias("fixed"))
    uses = scratch.put(uses)
    scratch.drop(once)
    every = lambda df: df.unionByName(df.withColumn("host", F.lit("*")))
    # the phrases' entropies add up along a branch, so they are summed at their own node first and then at the nodes above
    dull = F.col("mass") * F.least(F.lit(1.0), F.log("all") / math.log(COMMON))
    own = every(uses.where("NOT fixed")).groupBy("host", "path").agg(F.sum("mass").alias("mass"), F.sum(dull).alias("dull"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    content = own.withColumn("up", F.explode(above)).groupBy("host", F.col("up").alias("path")).agg(F.sum("mass").alias("mass"), F.sum("dull").alias("dull"))
    # one child sequence for each page, so their counts add up to the pages that have the node
    s = every(styles.drop("node")).groupBy("host", "path", "feature").agg(F.sum("n").alias("n"))
    s = s.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.count("*").alias("k"))
    m = F.greatest(F.col("m"), F.lit(2)).cast("double")
    pres = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log(m) * F.col("m") - F.col("nlogn")) / (F.col("m") * F.log(m))))
    cont = F.coalesce(1 - F.col("dull") / F.col("mass"), F.lit(0.0))
    w = F.pow(F.lit(GAMMA), F.col("k") - 1)  # a node of one child sequence is judged by its content
    t = s.join(content, ["host", "path"], "left")
    t = scratch.put(t.select("host", "path", "m", (w * cont + (1 - w) * pres * cont).alias("importance")))
    total = t.where("host = '*'").select("path", F.col("m").alias("m_all"), F.col("importance").alias("all"))
    trust = F.least(F.lit(1.0), F.col("m") / TRUST)
    t = t.where("host <> '*'").join(total, "path")
    t = t.withColumn("importance", trust * F.col("importance") + (1 - trust) * F.col("all"))
    inside = _in_article(F.regexp_replace("path", "(^|/)[^/]*$", ""))
    limit = F.when(inside, INSIDE).otherwise(threshold)
    last = F.element_at(F.split("path", "/"), -1)
    known = ~_in_article(last) & (F.col("m_all") >= LEAST)
    t = scratch.put(t.withColumn("low", known & (F.col("importance") < limit)).withColumn("inside", inside))
    stay = t.where("NOT low").select("host", F.explode(above).alias("up")).distinct().withColumnRenamed("up", "path")
    whole = t.where("low").join(stay, ["host", "path"], "left_anti").select("host", F.col("path").alias("what"))
    shared = uses.where("fixed").join(t.where("NOT low AND NOT inside").where(F.col("m") >= TRUST).select("host", "path"), ["host", "path"])
    return scratch.put(whole.unionByName(shared.select("host", F.concat("path", F.lit("/="), F.col("feature").cast("string")).alias("what"))))


def _removals(path: tuple[str, ...], text: str | None = None) -> list[str]:
    """The removals that concern a node: of the node itself, or of the phrases of a block in it."""
    at = "/".join(path)
    return [at] if text is None else [f"{at}/={h}" for h in phrases(text)]


def main_blocks(page: _Page, bad: frozenset[str]) -> list[str]:
    """The texts of the page that stay when the removals of its host are applied."""
    main = _main(page)
    drop = {p: main and not _in_main(p) or _noise(p) or any("/".join(p[:k]) in bad for k in range(1, len(p) + 1)) for p in {p for p, _ in page.blocks}}
    return [t for p, t in page.blocks if not drop[p] and not (bad and (r := _removals(p, t)) and all(x in bad for x in r))]


def extract_text(pages: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Columns of pages without html, with `text` (string) and n_chars (long); columns so named are replaced.

    Null or empty html gives ''.  Branches that are of low importance for the page's host go with all
    that lies in them, never text for what stands above it; so does what names make noise, and where a
    page has an article or main element that is not itself noise, what lies outside it.
    Character references are decoded, white space inside a block becomes one space, blocks are
    joined by one newline in page order.  Pages without a valid url share the host ''; rows of a
    repeated page_id are pages of their own, and equal pages have equal texts.  The removals are broadcast while
    they take at most REMOVAL_BYTES; beyond that each page is joined with those among its own nodes and phrases.
    """
    bad = low_importance(pages, threshold)
    size = bad.agg(F.sum(F.octet_length("host") + F.octet_length("what") + 100)).first()[0] or 0
    keep = [c for c in pages.columns if c not in (text, "n_chars", "html")]
    schema = pages.select(*keep).schema.add(text, "string").add("n_chars", "long")
    base = pages.select(*keep, pages["html"].alias("__html"), pages["url"].alias("__url"))
    if size <= REMOVAL_BYTES:
        table: dict[str, set[str]] = {}
        for r in bad.collect():
            table.setdefault(r.host, set()).add(r.what)
        shared = pages.sparkSession.sparkContext.broadcast({h: frozenset(x) for h, x in table.items()})
    else:
        shared = None
        base = _with_own_removals(base, bad)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none: frozenset[str] = frozenset()
        for b in batches:
            if shared is not None:
                bads = [shared.value.get(host_of(u), none) for u in b["__url"]]
            else:
                bads = [none if w is None else frozenset(w) for w in b["__what"]]
            out = ["\n".join(main_blocks(parse(html), bad)) for html, bad in zip(b["__html"], bads)]
            b = b[keep].copy()
            b[text], b["n_chars"] = out, [len(t) for t in out]
            yield b

    return base.mapInPandas(run, schema)


def _with_own_removals(base: DataFrame, bad: DataFrame) -> DataFrame:
    """base with __what: which of a page's own nodes and phrases go, found by joins on them; no host's removals are ever gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, html, k1, k2 in zip(b["__url"], b["__html"], b["__k1"], b["__k2"]):
                page, host = parse(html), host_of(url)
                own = {x for p, t in page.blocks for x in _removals(p, t)} | {x for p in {p for p, _ in page.blocks} for k in range(1, len(p) + 1) for x in _removals(p[:k])}
                rows += [(k1, k2, host, x) for x in own]
            yield pd.DataFrame(rows, columns=["__k1", "__k2", "host", "what"])

    key = [F.xxhash64("__url", "__html").alias("__k1"), F.xxhash64(F.lit(1), "__html", "__url").alias("__k2")]
    keyed = base.withColumns({"__k1": key[0], "__k2": key[1]})
    own = keyed.select("__url", "__html", "__k1", "__k2").mapInPandas(run, "__k1 bigint, __k2 bigint, host string, what string")
    found = own.join(bad, ["host", "what"]).groupBy("__k1", "__k2").agg(F.collect_set("what").alias("__what"))
    return keyed.join(found, ["__k1", "__k2"], "left").drop("__k1", "__k2")
