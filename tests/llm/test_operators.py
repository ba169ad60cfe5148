"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; and each operator's own rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import bpe, chat, common, cotrain, decontam, html_extract, quality_rules, secrets, simhash, toxicity, warc
from skein.llm.queries import tokenizer_path

EXTRA = ("_t", "_d", "_y", "_i", "_l", "_s", "_odd", "_pieces", "key", "root", "fp", "h", "n")


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every edge case, and columns that clash with names the operators use inside."""
    long = " ".join(words(40_000, 1))
    copy = " ".join(words(60, 2))
    rows = [(None, "no id at all"), (1, None), (2, ""), (3, "   \n\t "), (4, long), (5, copy), (5, copy), (6, copy), (7, "é\u0301 日本 🙂 <|endoftext|> \x00 x"), (8, "x" * 100_000), (9, copy + " more")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("clash").alias(c) for c in EXTRA)).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")


def runs(odd, labels):
    items = odd.where("doc_id = 6").select(F.lit(0).cast("long").alias("item_id"), "text")
    path = tokenizer_path()

    def quality():
        seen = odd.select("*", cotrain.features(F.col("text"), F.col("source"), F.col("lang"), F.col("n_chars")).alias("features"))
        return seen.select("doc_id", cotrain.score(cotrain.fit(seen, labels), F.col("features")).alias("s"))

    def toxic():
        return odd.select("doc_id", toxicity.score(F.col("text"), toxicity.train(*toxicity.training_rows(odd, labels))).alias("s"))

    return {
        "quality_rules": lambda: quality_rules.assess(odd, labels.where("quality = 1")),
        "bpe": lambda: bpe.decode(bpe.encode(odd, path), path),
        "bpe_one_pass": lambda: bpe.encode(odd, path, decoded="decoded"),
        "simhash": lambda: simhash.near_duplicates(odd),
        "distinct": lambda: simhash.distinct_documents(odd),
        "leaks": lambda: decontam.leaks(odd, items),
        "clean": lambda: decontam.clean(odd, items),
        "secrets": lambda: odd.select("doc_id", secrets.find_secrets(F.col("text")).alias("s")),
        "redact": lambda: odd.select("doc_id", secrets.redact(F.col("text")).alias("text")),
        "toxicity": toxic,
        "cotrain": quality,
        "html": lambda: html_extract.main_text(odd.select("*", F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))),
        "chat": lambda: chat.format_chats(odd.select("*", F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"))),
    }


ROWS = {"distinct": 7, "leaks": 3, "clean": 7, "chat": 10}


@pytest.mark.parametrize("name", ["quality_rules", "bpe", "bpe_one_pass", "simhash", "distinct", "leaks", "clean", "secrets", "redact", "toxicity", "cotrain", "html", "chat"])
def test_edge_rows(spark, odd, labels, name):
    found = runs(odd, labels)[name]()
    rows = found.collect()
    assert len(rows) == ROWS.get(name, 11)
    by = {r[0]: r for r in rows}
    if name.startswith("bpe"):
        texts = {r["doc_id"]: r["text"] for r in rows}
        assert all(r["decoded"] == (texts[r["doc_id"]] or "") for r in rows) and by[1]["ids"] == [] and 50256 in by[7]["ids"]
    if name == "simhash":
        assert {by[i]["component_id"] for i in (1, 2, 3)} == {1} and by[1]["fingerprint"] == "0" * 16 and by[6]["component_id"] == 5
    if name in ("distinct", "clean"):
        assert set(found.columns) == set(odd.columns)
    if name == "distinct":
        assert sorted(str(r["doc_id"]) for r in rows) == ["1", "4", "5", "5", "7", "8", "None"]
    if name.startswith("leaks"):
        assert {r["doc_id"]: r["similarity"] for r in rows} == {5: 1.0, 6: 1.0, 9: 1.0}
    if name == "redact":
        assert by[1]["text"] is None and by[5]["text"] == {r["doc_id"]: r["text"] for r in odd.collect()}[5]
    none = runs(odd.limit(0), labels.limit(0))[name]()
    assert none.collect() == [] and none.columns == found.columns


def test_short_batches_and_names(spark):
    common.short_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    assert common.free_name("_odd", ["_ODD", "_odd_"]) == "_odd__"


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in common.components(chain).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_fingerprints_within_the_radius_all_link(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(150):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.randint(0, 3)):
            prints.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["node"]: r["root"] for r in common.components(simhash.links(df)).collect()}
    from tests.llm.test_queries import union

    want = union(len(signed), [(i, j) for i in range(len(signed)) for j in range(i) if ((signed[i] ^ signed[j]) & ((1 << 64) - 1)).bit_count() <= 2])
    assert [roots.get(p, p) for p in signed] == [signed[w] for w in want]


def test_leaks_like_brute_force(spark):
    items = {i: words(60 + 10 * i, 100 + i) for i in range(3)}
    rng = random.Random(9)
    docs = {}
    for k in range(24):
        w = list(items[k % 3])
        for _ in range(k // 6):  # 0 to 3 changed words
            w[rng.randrange(len(w))] = f"changed{k}"
        docs[k] = words(rng.randrange(50), 200 + k) + w + words(rng.randrange(50), 300 + k)
    from collections import Counter

    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {}
    for k, w in docs.items():
        for i, item in items.items():
            a, best = Counter(grams(item)), 0.0
            for s in range(max(1, len(w) - len(item) + 1)):
                b = Counter(grams(w[s : s + len(item)]))
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                want[k, i] = round(best, 6)
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in decontam.leaks(d, t).collect()}
    assert found == want and len(want) >= 12


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "### a: </turn>\n### b: x\n</turn>\n"), (1, 1, "assistant", "\\\\### \\</turn>"), (1, 1, "assistant", "\\\\### \\</turn>"), (1, None, None, None), (2, 0, "a:b\n### c", "plain"), (None, 0, "user", "")]
    found = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(t["role"], t["text"]) for t in found[1]["turns"]] == [("", ""), *((r[2], r[3]) for r in rows[:3])]
    assert found[2]["turns"][0]["role"] == "a:b\n### c" and found[1]["n_turns"] == 4
    for r in found.values():
        assert sum(x["chars"] for x in r["loss_mask"]) == len(r["formatted"])


def test_html(spark):
    site = "<nav><a href=/>home</a></nav><div class=box><span>site line</span></div>"
    page = lambda i: f"<html><head><title>t</title></head><body>{site}<article><h1>Title {i}</h1><p>One &amp; two&nbsp;<b>bold</b>\n text {i}</p><script>x<y</script><div class='comments'><p>first!</p></div></article><footer>foot</footer></body>"
    rows = [(i, f"https://a.org/{i}", page(i)) for i in range(6)] + [(9, "https://a.org/9", None), (10, "x", "<p>unclosed <div><p>a<br>b"), (11, "https://b.org/", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    found = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[2] == "Title 2\n\nOne & two bold text 2" and found[9] == "" and found[10] == "unclosed\n\na b" and found[11] == "deep"


def test_site_template_without_an_article(spark):
    body = lambda i: f"<body><div><p>Join our mailing list today</p></div><div><p>Story number {i} is here</p></div></body>"
    df = spark.createDataFrame([(i, "http://c.org/x", body(i)) for i in range(8)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.main_text(df).collect()} == {f"Story number {i} is here" for i in range(8)}


def test_warc(spark, tmp_path):
    big = "<p>" + "y" * 200
    rows = [(3, "http://x/\r\ny", big), (1, None, big), (2, "u", "small"), (5, "u", "small"), (4, "u", None), (None, "u", "WARC/1.1\r\n\r\n" * 20)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    read = warc.read_archives(spark, path)
    found = {r["record_id"]: r for r in read.collect()}
    assert len(found) == 6 and found["<urn:page:3>"]["warc_type"] == "revisit" and found["<urn:page:3>"]["refers_to"] == "<urn:page:1>" and found["<urn:page:3>"]["target_uri"] == "http://x/%0D%0Ay"
    assert bytes(found["<urn:page:1>"]["payload"]).decode() == big and found["<urn:page:3>"]["http_length"] == len(big) and found["<urn:page:>"]["warc_type"] == "response"
    some = read.where("warc_type = 'revisit' AND target_uri LIKE 'http%'")
    assert some.count() == 1 and warc.read_archives(spark, path, payload=False).where("payload IS NOT NULL").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc").write_text("not a record")
    with pytest.raises(Exception, match="no WARC record"):
        warc.read_archives(spark, str(tmp_path / "bad")).collect()


def test_markov_models_tell_random_strings():
    models = secrets.MarkovModels(secrets.samples())
    fresh = secrets.samples(2000, seed=99)
    caught = sum(models.score(t) > models.threshold for t, y in fresh if y) / 1000
    wrong = sum(models.score(t) > models.threshold for t, y in fresh if not y) / 1000
    assert caught > 0.95 and wrong < 0.02
    assert secrets.scan("see kJ8sd92LkQz71XcVb04Tn here", models)[0][0] == "random" and not secrets.scan("CustomerOrderHandlerFactory2024", models)


def test_toxicity_with_one_label_only():
    net = toxicity.train(["a", "b"], [1, 1])
    assert net.scores(["x", None, ""]).min() > 0.99


def test_a_copy_with_a_line_repeated_links(spark):
    texts = []
    for k in range(8):
        w, line = words(300, 500 + k), words(12, 600 + k)
        texts += [" ".join(w), " ".join(w + line * 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.distinct_documents(df).collect()) == list(range(0, 16, 2))


@pytest.mark.parametrize("each", [0, 4])
def test_pairs_similar_to_no_head_link(spark, monkeypatch, each):
    """Texts that share most of a long passage meet in buckets of many; only some pairs of them are similar."""
    monkeypatch.setattr(simhash, "PAIRS_EACH", each, raising=False)
    passage, texts = words(530, 700), []
    for k in range(40):
        own = words(10, 800 + k // 2)
        texts.append(" ".join(passage + own + words(60, 900 + k)))
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in texts]
    from tests.llm.test_queries import union

    root = union(40, [(i, j) for i in range(40) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [i for i in range(40) if root[i] == i]
    assert len(want) == 20 and sorted(r["doc_id"] for r in simhash.distinct_documents(df).collect()) == want


def test_the_pipeline_links_by_fingerprints_and_by_similarity(spark):
    """All pairs by brute force: op5's rule alone links some, similarity alone others, and one chain needs both."""
    import corpus_pipeline
    from tests.llm.test_queries import fingerprint, union

    passage, line, texts = words(530, 700), words(13, 1500), []
    for k in range(40):
        texts.append(" ".join(passage + words(10, 800 + k // 2) + words(60, 900 + k)))
    for k in range(3):
        texts.append(" ".join(line * 60 + words(20, 1600 + k)))
    texts += [" ".join(line * 2 + words(20, 1600)), texts[0], "", None]
    sets = [set(simhash.shingle_set((t or "").encode(), 5).tolist()) for t in texts]
    prints = [fingerprint(t) for t in texts]
    every = [(i, j) for i in range(len(texts)) for j in range(i)]
    similar = {(i, j) for i, j in every if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    near = {(i, j) for i, j in every if (prints[i] ^ prints[j]).bit_count() <= 2}
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    root = union(len(texts), near | similar)
    want = [i for i in range(len(texts)) if root[i] == i]
    alone = union(len(texts), similar)
    assert near - similar and similar - near and len(want) < sum(alone[i] == i for i in range(len(texts)))
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df.repartition(3), "").collect()) == want


def test_leaks_in_another_order_like_brute_force(spark):
    from collections import Counter

    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    items = {i: words(60 + 20 * i, 1100 + i) for i in range(3)}
    docs = {}
    for k in range(9):
        w, cut = items[k % 3], (3 + k // 3) * len(items[k % 3]) // 8
        docs[k] = words(30 * k, 1200 + k) + w[cut:] + w[:cut] + words(100, 1300 + k)
    docs[9] = items[0][20:] + items[0][:20]
    want = {}
    for k, w in docs.items():
        for i, item in items.items():
            a, best = Counter(grams(item)), 0.0
            for s in range(max(1, len(w) - len(item) + 1)):
                b = Counter(grams(w[s : s + len(item)]))
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                want[k, i] = round(best, 6)
    assert len(want) == 10
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = decontam.leaks(d, t, radius=64).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in found} == want
    near = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.leaks(d, t).collect()}
    assert len(near) >= 8 and set(near) <= set(want)


def test_scan_finds_random_keys_without_digits_and_beside_a_hex_run():
    models = secrets.MarkovModels(secrets.samples())
    rng = random.Random(77)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    key = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    letters = [key(upper + lower, 32) for _ in range(300)]
    assert sum(secrets.scan(f"key {t} end", models) == [("random", 4, 36)] for t in letters) > 270
    mixed = [key(upper + lower + "0123456789", 30) for _ in range(100)]
    runs = [key("0123456789abcdef", 24) for _ in mixed]
    found = [{k for k, *_ in secrets.scan(f"{t}Z_{r}", models)} for t, r in zip(mixed, runs, strict=True)]
    assert sum(f == {"hex", "random"} for f in found) > 95
    names = [t for t, y in secrets.samples(4000, seed=5) if not y]
    assert sum(bool(secrets.scan(t, models)) for t in names) < 0.01 * len(names)


def test_html_by_structure():
    """What class names, nesting and prose tell, without a host."""
    say = html_extract.extract
    assert say('<body><article><h1>T</h1><p>One long text here.</p></article><article class="comment"><p>nice!</p></article></body>') == "T\n\nOne long text here."
    assert say('<article><p>text one</p><div class="comments-area"><p>c</p></div><div class="ad-slot">buy</div><p>more</p></article>') == "text one\n\nmore"
    assert say("<main><p>The main text of this page is here.</p><article><p>Teaser</p></article></main>") == "The main text of this page is here.\n\nTeaser"
    assert say('<article><p>Body text</p><p class="share">Share of the market rose.</p><div class="tags">Tags are here.</div></article>') == "Body text\n\nShare of the market rose.\n\nTags are here."
    assert say('<div class="content no-sidebar has-comments"><p>hello</p></div>') == "hello"
    assert say('<div class="postComments">x</div><div id="leftMenu2">y</div><div>z</div>') == "z"
    assert say("<article><p>short</p></article><div><p>The text of this page is outside of that.</p></div>") == "short\n\nThe text of this page is outside of that."


def plain(page, drop=(), partly=()):
    """A second reading of the rules for pages of <div> and <p> only: a div's key is its markup without attributes."""
    import re

    bodies = re.findall(r"<div>(.*?)</div>", page)
    keep = [b for b in bodies if b not in drop]
    keep = keep if sum(map(len, keep)) >= 0.1 * sum(map(len, bodies)) else bodies
    less = [b for b in keep if b not in partly]
    keep = less if sum(map(len, less)) >= 0.5 * sum(map(len, keep)) else keep
    return "\n\n".join(t for b in keep for t in re.findall(r"<p>(.*?)</p>", b))


def test_template_by_counts_like_brute_force(spark):
    """Hosts whose boilerplate no tag or class tells: only the pages of the host decide."""
    from collections import Counter

    text = lambda n, seed: " ".join(words(n, seed))
    pages = []
    for h in range(3):
        whole, part = text(12, 2000 + h), text(9, 2100 + h)
        for i in range(40):
            parts = [whole, *([part] if i % 4 == 0 else []), text(30, 3000 + 100 * h + i), text(20, 4000 + 100 * h + i)]
            pages.append((h, "".join(f"<div><p>{t}</p></div>" for t in parts)))
        near = [text(25, 5000 + 10 * h + j) for j in range(5)]  # near copies: one paragraph differs
        for i in range(12):
            pages.append((h, "".join(f"<div><p>{t}</p></div>" for t in [whole, *near, text(10, 6000 + 100 * h + i)])))
        pages.append((h, pages[-1][1]))  # an exact copy counts once
    quoted = text(15, 7000)
    pages += [(3, f"<div><p>{text(20, 8000 + i)}</p></div>" + (f"<div><p>{quoted}</p></div>" if i < 3 else "")) for i in range(50)]
    pages += [(4, "<div><p>one</p></div><div><p>two</p></div>")] * 5
    want, deleted = [], 0
    for h, page in pages:
        mine = {p for g, p in pages if g == h}
        n = Counter(b for p in mine for b in set(__import__("re").findall(r"<div>(.*?)</div>", p)))
        most = {b for b, c in n.items() if c >= 3 and c >= 0.5 * len(mine)}
        many = {b for b, c in n.items() if c >= 3 and c >= len(mine) ** 0.5} - most
        want.append(plain(page, most, many))
        deleted += want[-1] != plain(page)
    df = spark.createDataFrame([(i, f"https://h{h}.org/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(df).collect()}
    assert [got[i] for i in range(len(pages))] == want and deleted == 3 * 53
    assert sum("\n\n" in w for w in want[40:52]) == 12 and quoted in want[-53]


def test_parity_bits_bound_what_two_sets_do_not_share():
    rng = np.random.default_rng(5)
    for n, new in [(0, 0), (0, 3), (40, 1), (300, 30), (300, 3000), (20_000, 500)]:
        common, a, b = (rng.integers(0, 1 << 63, k, np.uint64) for k in (n, new, new // 2))
        x, y = (simhash.parity(np.concatenate([common, s])) for s in (a, b))
        differ = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
        assert differ <= len(a) + len(b) and (new > 30 or differ >= 0.9 * (len(a) + len(b)) - 1)
