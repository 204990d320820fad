"""The registered queries and the operators against brute force, exact round trips and edge cases."""

import collections
import hashlib
import html as html_lib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import bpe, chat, decontaminate, itq, licenses, linededup, quality, queries, sigtree, sitetree, toxicity
from basalt.llm.common import components
from tests import oracle

SF = "/root/testdata/sf0.001"
ODD = [None, "", "   \n\t", "x", "<|endoftext|>", "a\x00b \U0001f600 é́ 日本語", "word " * 3000, "a" * 20000, "\n\n\n\n", "dup line\nsame\nthing\nmore", "dup line\nsame\nthing\nmore"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, and extra columns with names that operators make."""
    rows = [(k, t, "en", k) for k, t in enumerate(ODD)] + [(None, "text without an id\nb\nc", None, None), (3, "x", "en", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_removed long")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string, n_removed long")


LABELS = "doc_id long, quality int, toxic int"


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    ref, own = Tokenizer.from_file(path), bpe.ForcedBoundaryBpe(open(path, encoding="utf-8").read())
    random.seed(4)
    bits = ["a", "The", " ", "  ", "\n", "\t", "é", "日本", "'s", "'LL", "<|endoftext|>", "<|endo", "1", "٣", "\x1c", "\x85", "\xa0", "aaaa", "!!", "$$$", "\U00010940", "\U000323b0", "՘", "‍"]
    texts = [t for t in ODD if t is not None] + ["".join(random.choice(bits) if random.random() < 0.9 else chr(random.choice([random.randrange(0xD800), random.randrange(0xE000, 0x110000)])) for _ in range(random.randrange(30))) for _ in range(3000)]
    for t in texts:
        want = ref.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert own.decode(got) == ref.decode(want, skip_special_tokens=False)


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op10_bpe_encoding(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = ref.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges(odd, none):
    out = bpe.encode_documents(odd, decoded="back").collect()
    assert len(out) == len(ODD) + 2 and all((r.back or "") == (r.text or "") for r in out)
    assert bpe.encode_documents(none).count() == 0


def test_cut_pairs_lie_in_no_token():
    own = bpe.ForcedBoundaryBpe(open(bpe.default_vocabulary(), encoding="utf-8").read())
    assert not any(own.cut[a << 8 | b] for t in own.ids for a, b in zip(t, t[1:]))


def chat_digests(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-(2**70) if t is None else t, r or "", x or ""))
    out = {}
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_query_and_edges(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    probe = "\\### Assistant: </turn> ok"
    want = chat_digests([*rows, (-7, 0, "user", probe), (-7, 1, "assistant", probe)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op8_chat_formatting(spark, SF).collect()}
    assert got == want
    hard = [(1, 0, "a", "x"), (1, 1, "a", None), (1, 2, "assi\\c:t<", "\\l\\\\h#<turn> \n</turn>\n"), (None, None, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (2, 0, "user", " <turn> "), (3, 0, "user", "\\"), (3, 1, "assistant", "\\\\<"), (3, None, "assistant", "z" * 70000)]
    df = spark.createDataFrame(hard, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == chat_digests(hard)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    merged = {r.conv_id: [b.role for b in r.blocks] for r in chat.format_conversations(df).collect()}
    assert merged[2] == ["user", "assistant"] and merged[1] == ["a", "assi\\c:t<"]


def test_html_query(spark):
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op6_html_extraction(spark, SF).collect():
        main = raw[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = [re.sub(r"\s+", " ", html_lib.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in re.split("<p>|<h1>", main)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_html_edges(spark):
    junk = '<header>H</header><div class="cookie-notice">C</div><div id="sidebar">S</div><form>F</form><div role="navigation">N</div>'
    body = "<h2>T &amp; x</h2>text&nbsp;one <b>bold</b><br>two<p>a<p>b<script>no</script><!-- c --><div class='comments'>gone</div>"
    rows = [(1, "http://a.b/", None), (2, None, ""), (3, "http://[bad", "<p>x &lt; y<p> z<li>q"), (4, "http://h/", f"<html><head><title>t</title></head><body class=menu>{junk}<article><header>Top</header>{body}</article><footer>f</footer>"), (5, "http://h/", f"<body>{junk}<div>{body}</div>"), (5, "http://h/", "<p>unclosed <script>var")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("x"))
    got = collections.defaultdict(list)
    for r in sitetree.extract_text(df).collect():
        got[r.page_id].append(r.text)
    assert got[1] == [""] and got[2] == [""] and got[3] == ["x < y\nz\nq"]
    assert got[4] == ["Top\nT & x\ntext one bold two\na\nb"]
    assert sorted(got[5]) == ["T & x\ntext one bold two\na\nb", "unclosed"]
    assert sitetree.extract_text(df.limit(0)).count() == 0


def test_style_tree_drops_what_a_host_repeats(spark):
    rows = [(k, "http://site.x/%d" % k, f"<body><div class='zz'>Same words everywhere</div><div class='yy'><p>Own text number {k} {k * 7919}</p></div>") for k in range(40)]
    got = sitetree.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Own text number {r.page_id} {r.page_id * 7919}" for r in got)


def test_style_tree_keeps_what_lies_in_a_repetitive_ancestor(spark):
    menu = lambda n: "".join(f"<div class='m{j}'>Menu words {j}</div>" for j in range(n))
    text = lambda k, n: [f"Own text {k} of part {j} {k * 7919 + j}" for j in range(n)]
    part = lambda ts: "".join(f"<p>{t}</p>" for t in ts)
    rows, want = [], {}
    for h, (fixed, own) in enumerate([(20, 10), (5, 4), (10, 10)]):
        for k in range(100):
            ts = text(k, own)
            # the first two by containers, one host with an article, one with menu and text in equal elements
            body = [f"<div id='page'>{menu(fixed)}<div class='zz'>{part(ts)}</div></div>", f"<div id='page'>{menu(fixed)}<article>{part(ts)}</article></div>", f"<div id='page'>{part([f'Menu {j}' for j in range(2 * fixed)])}{part(ts)}</div>"][h]
            rows.append((len(rows), f"http://h{h}.x/{k}", f"<html><body>{body}</body></html>"))
            want[len(want)] = "\n".join(ts)
    # ten texts of which nine in ten pages are copies, with another advertisement on each
    for k in range(100):
        ts = text(k if k < 10 else 0, 6)
        rows.append((len(rows), f"http://h9.x/{k}", f"<html><div class='container'><div class='ad'>Buy {k}</div>{menu(4)}<div class='zz'>{part(ts)}</div></div></html>"))
        want[len(want)] = "\n".join(ts)
    got = {r.page_id: r.text for r in sitetree.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want


def test_html_noise_in_articles(spark):
    bare = "<nav>N</nav><aside>A</aside><form>F</form><footer>X</footer>"
    rows = [
        (1, f"<main><header>Top</header>{bare}<div>text</div></main>", "Top\ntext"),
        (2, f"<article>{bare}<p>one</p><section>two</section></article>", "one\ntwo"),
        (3, "<div class='post'>real text</div><div class='comments'><article>me too</article></div>", "real text"),
        (4, "<div class='post'>real text</div><article class='teaser'>read on</article><section class='related'><article>next</article></section>", "real text"),
        (5, "<div class='post'>real text</div><article></article>", "real text"),
        (6, "<div class='post'>about</div><article>real text</article><div class='comments'><article>me too</article></div>", "real text"),
    ]
    df = spark.createDataFrame([(k, f"http://h{k}.x/", h) for k, h, _ in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in sitetree.extract_text(df).collect()} == {k: t for k, _, t in rows}


def test_line_dedup_equals_sql(spark, odd, none):
    c = oracle.connect("/root/testdata/sf0.01")
    assert oracle.difference(queries.op3_line_dedup(spark, "/root/testdata/sf0.01"), c, linededup.SQL) == ""
    got = collections.defaultdict(list)
    for r in linededup.dedup_lines(odd).collect():
        got[r.doc_id].append((r.text, r.n_removed))
    assert got[0] == [(None, 0)] and got[8] == [("\n\n\n\n", 0)] and got[9] == [(ODD[9], 0)] and got[10] == [("", 4)]
    assert got[None] == [("text without an id\nb\nc", 0)] and got[3] == [("x", 0), ("x", 0)]
    assert linededup.dedup_lines(none).count() == 0
    plan = linededup.dedup_lines(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def jaccard(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    users = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            users[x].append(i)
    both = collections.Counter((a, b) for u in users.values() for k, a in enumerate(u) for b in u[k + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(n, seed):
    random.seed(seed)
    base = [[f"w{random.randrange(300)}" for _ in range(random.choice([3, 5, 8, 20, 60, 200]))] for _ in range(40)]
    rows = []
    for k in range(n):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, len(w) // 12, len(w) // 8])):
            w[random.randrange(len(w))] = f"w{random.randrange(300)}"
        rows.append((k, " ".join(w)))
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "One"), (9004, "one"), (9005, "x" * 30000)]


@pytest.mark.parametrize("chunk", [1024, 16])
def test_jaccard_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(sigtree, "CHUNK", chunk)
    rows = near_copies(700, chunk)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in sigtree.jaccard_components(df).collect()} == jaccard(rows)


def test_jaccard_query_and_edges(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_ngram_jaccard(spark, SF).collect()} == jaccard(docs)
    out = sigtree.jaccard_components(odd).collect()
    assert len(out) == len(ODD) + 2 and {r.component_id for r in out if r.doc_id is None} == {None}
    assert {r.component_id for r in out if r.doc_id in (9, 10)} == {9}
    assert sigtree.jaccard_components(none).count() == 0
    assert sorted(r.doc_id for r in sigtree.keep_one(odd).where("doc_id >= 9").collect()) == [9]


def cosines(rows):
    good = {i: (np.array(x, float), (l, len(x))) for i, x, l in rows if l is not None and x is not None and all(e is not None and np.isfinite(e) for e in x) and any(x)}
    n, up = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for label in {l for _, l in good.values()}:
        ids = [i for i in sorted(good) if good[i][1] == label]
        x = np.array([good[i][0] for i in ids])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1))):
            n[ids[a]] += 1
            n[ids[b]] += 1
            p, q = find(ids[a]), find(ids[b])
            up[max(p, q)] = min(p, q)
    return n, {i: find(i) for i in up}


@pytest.mark.parametrize("chunk", [2048, 64])
def test_embeddings_recall(spark, monkeypatch, chunk):
    monkeypatch.setattr(itq, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    rows = []
    add = lambda x, l: rows.append((len(rows), [float(np.float32(e)) for e in x], int(l)))
    for _ in range(150):
        base, label = rng.standard_normal(32), rng.integers(3)
        for _ in range(rng.integers(1, 8)):
            add(base / np.linalg.norm(base) + rng.choice([0, 0.05, 0.12, 0.2]) * rng.standard_normal(32) / 32**0.5, label)
    base = rng.standard_normal(32)
    for k in range(300):
        add(base + (0.05 * rng.standard_normal(32) if k % 2 else 0), 1)
    for _ in range(1200):
        add(rng.standard_normal(32), rng.integers(3))
    k = len(rows)
    rows += [(k, None, 1), (k + 1, [0.0] * 32, 1), (k + 2, [float("nan")] * 32, 1), (k + 3, [None] + [1.0] * 31, 1), (k + 4, [1.0] * 32, None), (k + 5, [1.0] * 32, 1), (k + 6, [2.0] * 32, 1), (k + 7, [1.0, 2.0], 1), (k + 8, [float("inf")] + [1.0] * 31, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r.vec_id: r for r in itq.near_duplicates(df).collect()}
    n, comp = cosines(rows)
    assert len(got) == len(rows) and all(got[i].n_links <= n[i] for i in n)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(n.values())
    assert np.mean([got[i].component_id == comp[i] for i in comp]) >= 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert itq.near_duplicates(df.limit(0)).count() == 0


def common_direction(norm, n=2500, dim=48, seed=5):
    """Unit vectors with a mean of about the norm given, and a partner of each at cosine 0.98 to 0.985."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) / dim**0.5 * (1 - norm**2) ** 0.5
    x[:, 0] += norm
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.standard_normal(x.shape)
    e -= (e * x).sum(1, keepdims=True) * x
    c = rng.uniform(0.9801, 0.985, (n, 1))
    return x, c * x + (1 - c**2) ** 0.5 * e / np.linalg.norm(e, axis=1, keepdims=True)


@pytest.mark.parametrize("norm", [0.0, 0.8, 0.9, 0.97])
def test_tables_reach_recall_with_a_common_direction(norm):
    x, y = common_direction(norm)
    model, tables, bits = itq.learn(np.concatenate([x, y]), 100_000)
    a, b = model.substrings(x, tables, bits), model.substrings(y, tables, bits)
    assert (a == b).any(1).mean() >= 0.985


def test_embeddings_with_a_common_direction(spark):
    x, y = common_direction(0.9)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(np.concatenate([x, y]).astype(np.float32))]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).agg(F.sum("n_links")).first()[0]
    z = np.array([v for _, v, _ in rows])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    assert got >= 0.98 * ((z @ z.T >= itq.COSINE).sum() - len(z))


def test_embeddings_query(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, comp = cosines(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op5_embedding_dedup(spark, SF).collect()}
    assert got == {i: (n[i], comp[i]) for i in n}


def test_components_of_long_paths(spark, monkeypatch):
    from basalt.llm import common

    edges = [(k, k + 1) for k in range(60)] + [(100, 102), (102, 101), (5, 5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    want = {k: 0 for k in range(61)} | {100: 100, 101: 100, 102: 100}
    for limit in (common.ONE_TASK_EDGES, 0):
        monkeypatch.setattr(common, "ONE_TASK_EDGES", limit)
        assert {r.id: r.comp for r in components(spark, df).collect()} == want


def leaks(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, t in docs:
        d = words(t)
        for j, u in items:
            w = words(u)
            if w and d:
                code = {x: k for k, x in enumerate({*w, *d})}
                n, _ = decontaminate.edit_infix(np.array([code[x] for x in w]), np.array([code[x] for x in d]))
                if n <= int(0.25 * len(w)):
                    out.add((i, j))
    return out


def test_decontamination(spark, odd, none):
    random.seed(8)
    items = [(k, " ".join(f"t{random.randrange(400)}" for _ in range(random.choice([4, 6, 12, 20, 40])))) for k in range(30)] + [(50, None), (51, ""), (52, "Wörd ÉTÉ, one two: three four")]
    docs = []
    for k in range(250):
        w = (random.choice(items[:30])[1]).split()
        for _ in range(random.randint(0, len(w) // 3)):
            at = random.randrange(len(w))
            w[at : at + random.randint(0, 1)] = random.choice([[], ["zz"], ["t1"]])
            w = w or ["zz"]
        docs.append((k, " ".join([f"t{random.randrange(400)}" for _ in range(30)] + w + ["end."] * random.randint(0, 9))))
    docs += [(900, "intro wörd été one  TWO three four"), (901, None), (902, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b).collect()]
    want = leaks(docs, items)
    assert len(found) == len({*found}) and {*found} <= want and len(want & {*found}) >= 0.98 * len(want) and (900, 52) in found
    assert decontaminate.find_leaks(odd, b).count() == 0 and decontaminate.find_leaks(none, b).count() == 0 and decontaminate.find_leaks(d, b.limit(0)).count() == 0
    clean = {r.doc_id for r in decontaminate.remove_leaking(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in found}
    assert decontaminate.remove_leaking(odd, b).count() == len(ODD) + 2


def test_decontamination_in_blocks(spark, monkeypatch):
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted(map(tuple, decontaminate.find_leaks(d, b).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK", 9)
    assert sorted(map(tuple, decontaminate.find_leaks(d, b).collect())) == one and one


def test_quality_held_out(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op1_quality_classifier(spark, sf).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert held.doc_id.map(lambda i: __import__("zlib").crc32(str(i).encode()) % 3 == 1).all()
    assert ((held.score >= 0.5) == (held.predicted == 1)).all() and held.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() > 0.95
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    assert quality.score_documents(odd, model).where("score IS NOT NULL").count() == len(ODD) + 2
    assert quality.score_documents(none, model).count() == 0
    empty = quality.train(none, spark.createDataFrame([], LABELS))
    assert {r.score for r in quality.score_documents(odd, empty).collect()} == {0.5}


def test_quality_ignores_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    x = np.random.default_rng(0).random((20, len(quality.STATS)))
    assert np.allclose(a.score(x), b.score(x))


def test_toxicity_held_out(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op7_toxicity(spark, sf).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.toxic_predicted == held.toxic).mean() > 0.97 and held.severity.between(0, 3).all()
    assert held[held.toxic == 1].severity.mean() > held[held.toxic == 0].severity.mean() + 1
    empty = toxicity.train(none, spark.createDataFrame([], LABELS))
    assert toxicity.score_documents(odd, empty).count() == len(ODD) + 2
    assert toxicity.score_documents(none, empty).count() == 0


def test_ordinal_regression_recovers_grades():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 4))
    y = np.digitize(x @ [2.0, -1.0, 0.5, 0.0] + rng.logistic(size=3000), [-1.0, 0.5, 2.0])
    w, theta = toxicity.fit_ordinal(x, y, 4, l2=0.0)
    assert np.allclose(w, [2.0, -1.0, 0.5, 0.0], atol=0.25) and np.allclose(theta, [-1.0, 0.5, 2.0], atol=0.25)


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "code\nand more"), (3, "a/b/d.py", "x\nLicensed under the Apache License, Version 2.0.\ny"), (4, "e/f.py", "nothing"), (5, None, None),
        (6, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (7, "top.py", ""), (8, "a/z.py", "the version of this is under"), (8, "a/z.py", "the version of this is under"),
    ]
    df = spark.createDataFrame(rows, "file_id long, path string, text string")
    got = collections.defaultdict(set)
    for r in licenses.inherit(licenses.scan(df)).collect():
        got[r.file_id].add((r.license, r.effective_license, r.license_from, r.license_dir))
    assert got == {1: {("MIT", "MIT", "header", None)}, 2: {(None, "GPL-3.0", "directory", "a/b")}, 3: {("Apache-2.0", "Apache-2.0", "header", None)}, 4: {(None, None, None, None)}, 5: {(None, None, None, None)}, 6: {("GPL-3.0", "GPL-3.0", "header", None)}, 7: {(None, None, None, None)}, 8: {(None, "MIT", "directory", "a")}}
    assert licenses.inherit(licenses.scan(df.limit(0))).count() == 0


def test_licence_texts_and_wrapped_notices(spark):
    texts = dict(licenses.TEXTS)
    filled = texts["BSD-3-Clause"].replace("<year>, <copyright holder>", "2019, Jane Roe and others")
    mit = texts["MIT"].replace("<year> <copyright holders>", "2021 A. Person").split("Permission")[1]
    wrapped = {
        "MIT": "# Permission is hereby granted, free of charge, to any person obtaining\n# a copy of this software and associated documentation files",
        "GPL-3.0": "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by",
        "BSD-3-Clause": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are\n * met:",
    }
    files = [(n, f"{n}/LICENSE", t) for n, t in texts.items()] + [("BSD-3-Clause", "b/LICENSE", filled), ("MIT", "m/LICENSE", "Copyright (c) 2021\n\nPermission" + mit)]
    files += [(n, f"src/{n}.py", f"first line\n{t}\n" + "".join(f"name{j} = call{j}(value{j})\n" for j in range(40))) for n, t in wrapped.items()]
    rows = [(k, p, t) for k, (_, p, t) in enumerate(files)] + [(90, "MPL-2.0/src/a.c", "code"), (91, "x/y.c", "the program\nis here\nand there"), (92, "z/LICENSE", "Released\nunder\nthe\nMIT\nLicense")]
    got = {r.file_id: r for r in licenses.inherit(licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string"))).collect()}
    assert [got[k].license for k in range(len(files))] == [n for n, _, _ in files]
    assert all(got[k].is_license_file == p.endswith("LICENSE") for k, (_, p, _) in enumerate(files))
    assert all(got[k].n_headers == 1 for k, (_, p, _) in enumerate(files) if p.startswith("src/"))
    assert got[90].effective_license == "MPL-2.0" and got[91].license is None
    assert (got[92].license, got[92].is_license_file) == ("MIT", True)


def test_license_query_finds_every_notice(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    notices = [t for _, t in licenses.TEMPLATES]
    want = {i for i, t in texts.items() if any(line.strip() in notices for line in t.split("\n"))}
    assert {r.doc_id for r in queries.op9_license_scan(spark, sf).where("license IS NOT NULL").collect()} == want


def hide_names(html):
    """The page with every landmark element as a div and every class as an opaque word: only structure and texts tell."""
    word = lambda w: "x" + hashlib.md5(w.encode()).hexdigest()[:6]
    for tag in ("nav", "article", "footer", "aside", "header", "main", "form"):
        html = re.sub(rf"<{tag}\b[^>]*>", f'<div class="{word(tag)}">', html).replace(f"</{tag}>", "</div>")
    return re.sub(r'class="(ad)"', lambda m: f'class="{word(m[1])}"', html)


@pytest.mark.parametrize("most", [None, 0])
def test_style_tree_decides_without_names(spark, monkeypatch, most):
    """With names hidden, entropy alone gives the texts; with most=0 each page is joined with its own removals."""
    if most is not None:
        monkeypatch.setattr(sitetree, "REMOVAL_BYTES", most)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        main = r.html.split("<article>")[1].split("</article>")[0]
        parts = [re.sub(r"\s+", " ", html_lib.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in re.split("<p>|<h1>", main)]
        want[r.page_id] = "\n".join(p for p in parts if p)
    hidden = spark.createDataFrame([(r.page_id, r.url, hide_names(r.html)) for r in pages.collect()], pages.select("page_id", "url", "html").schema)
    got = {r.page_id: r.text for r in sitetree.extract_text(hidden).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)


def test_html_repeats_and_long_pages(spark):
    long = "<div class='post'>" + "".join(f"<p>Part {k} of a long text.</p>" for k in range(5000)) + "</div>"
    rows = [(1, None, long), (1, None, long), (None, "http://a.b/", "<p>no id</p>"), (2, "http://a.b/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(7)).withColumn("host", F.lit("x")).withColumn("sig", F.lit(1))
    got = collections.defaultdict(list)
    for r in sitetree.extract_text(df).collect():
        got[r.page_id].append((r.text, r.n_chars, r.host, r.sig))
    want = "\n".join(f"Part {k} of a long text." for k in range(5000))
    assert got == {1: [(want, len(want), "x", 1)] * 2, None: [("no id", 5, "x", 1)], 2: [("", 0, "x", 1)]}


def test_line_dedup_with_shuffled_positions(spark, odd, monkeypatch):
    """The join beyond BROADCAST_BYTES gives the same rows."""
    want = sorted(map(repr, linededup.dedup_lines(odd).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", -1)
    assert sorted(map(repr, linededup.dedup_lines(odd).collect())) == want
    c = oracle.connect("/root/testdata/sf0.001")
    assert oracle.difference(queries.op3_line_dedup(spark, "/root/testdata/sf0.001"), c, linededup.SQL) == ""


def test_jaccard_of_a_block_above_the_default_chunk(spark):
    random.seed(11)
    base = [f"w{random.randrange(5000)}" for _ in range(120)]
    rows = []
    for k in range(sigtree.CHUNK + 400):
        w = list(base)
        for _ in range(random.choice([1, 2, 3, 4, 6, 9])):
            w[random.randrange(len(w))] = f"v{random.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in sigtree.jaccard_components(df).collect()} == jaccard(rows)


def test_jaccard_last_step_sends_a_set_to_its_own_tree_only(spark, monkeypatch):
    """All documents are in one block by a common passage, and every document's shingles are in others; few can link."""
    random.seed(12)
    common, rows = [f"c{k}" for k in range(60)], []
    for family in range(60):
        parts = [[f"f{family}p{p}w{k}" for k in range(60)] for p in range(4)]
        for out in range(4):
            rows.append([w for p in range(4) if p != out for w in parts[p]] + common)
        near = list(rows[-1 - family % 4])
        near[random.randrange(20, 160)] = near[random.randrange(20, 160)] = "edit"
        rows.append(near)
    random.shuffle(rows)
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    sent, joined = [], sigtree._joined
    monkeypatch.setattr(sigtree, "_joined", lambda df, keys: sent.append(df.count()) or joined(df, keys))
    monkeypatch.setattr(sigtree, "CHUNK", 16)
    monkeypatch.setattr(sigtree, "ROUNDS", 0)  # else the last step has little left to link
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sigtree.jaccard_components(df).collect()}
    assert got == jaccard(rows) and len({c for _, c in got.values()}) == 240
    assert len(sent) == 2 and sent[1] <= len(rows)


def test_components_end_in_one_task_as_soon_as_few_edges_are_left(spark, monkeypatch):
    """The forests of the tasks hold equal edges: too many at first, few once they are distinct."""
    from basalt.llm import common

    pairs = [(k - k % 10, k) for k in range(200) if k % 10]
    df = spark.createDataFrame([p for _ in range(8) for p in pairs], "a long, b long").repartition(8)
    steps, put = [], common.Scratch.put
    monkeypatch.setattr(common.Scratch, "put", lambda self, df: steps.append(1) or put(self, df))
    monkeypatch.setattr(common, "ONE_TASK_EDGES", len(pairs))
    assert {r.id: r.comp for r in components(spark, df).collect()} == {k: k - k % 10 for k in range(200)}
    assert len(steps) == 3
