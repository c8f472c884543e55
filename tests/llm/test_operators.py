"""Every operator against brute force on awkward rows, empty tables and clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketry.llm import bpe, components, exact_dedup, html_text, induced, licenses, minhash, mixing, ordinal, quality_rules, repeats, textbytes, url_filter
from tests.llm import cases

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
EMPTY: list[tuple] = []


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return cases.settled(spark, cases.table(spark, extra=True), tmp_path_factory.mktemp("docs"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return cases.settled(spark, cases.table(spark, EMPTY), tmp_path_factory.mktemp("empty"))


def multiset(values):
    return sorted(map(repr, values))


# quality rules

def test_counts_of_awkward_texts(spark, docs):
    labels = spark.createDataFrame([(0, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality_rules.quality_rules(docs, labels).collect()
    want = [(r[0], *cases.counts(r[1])) for r in cases.rows()]
    assert multiset(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got
    ) == multiset(want)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed)  # three labels certify nothing


def test_cutoffs_are_certified_per_stratum(spark):
    symbol = [0.0] * 2000 + [0.35] * 400
    data = [(i, "en", False, s, 0.0, 0.0, 0.0, 0.0) for i, s in enumerate(symbol)]
    data += [(5000 + i, "fr", False, 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(30)]
    scored = spark.createDataFrame(data, "doc_id long, stratum string, base_failed boolean, " + ", ".join(f"{r} double" for r in quality_rules.RULES))
    labels = spark.createDataFrame([(i, int(i < 2000)) for i in range(2400)] + [(5000 + i, 1) for i in range(30)], "doc_id long, quality int")
    cuts = {r.stratum: r for r in quality_rules.certified_cutoffs(scored, labels).collect()}
    assert cuts["en"].symbol_share_cut == min(quality_rules.SHARES)
    assert cuts["fr"].symbol_share_cut is None  # 30 good rows cannot prove one false rejection in a hundred
    kept = {r.doc_id: r.kept for r in quality_rules.judge(scored, quality_rules.certified_cutoffs(scored, labels)).collect()}
    assert all(kept[i] for i in range(2000)) and not any(kept[i] for i in range(2000, 2400)) and kept[5000]


def test_binomial_tail_equals_the_sum(spark):
    import math
    for hits, total, rate in ((0, 10, 0.1), (3, 40, 0.05), (40, 4000, 0.01), (0, 0, 0.2)):
        want = sum(math.comb(total, i) * rate**i * (1 - rate) ** (total - i) for i in range(hits + 1))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(hits).cast("long"), F.lit(total).cast("long"), rate).alias("p")).first()["p"]
        assert got == pytest.approx(want, rel=1e-9)


def test_passing_keeps_rows_and_columns(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality_rules.passing(docs, labels)
    assert kept.dtypes == docs.dtypes
    good = [r for r in cases.rows() if (c := cases.counts(r[1]))[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    assert multiset(r.doc_id for r in kept.collect()) == multiset(r[0] for r in good)
    assert quality_rules.passing(empty, labels).count() == 0


# suffix arrays

@given(st.lists(st.integers(97, 99), min_size=1, max_size=40), st.integers(1, 3))
@settings(max_examples=150, deadline=None)
def test_induced_order_and_prefixes(letters, copies):
    data = bytes(letters * copies)
    text = np.frombuffer(data, np.uint8)
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert induced.suffix_array(text).tolist() == want
    previous, lengths = induced.common_prefixes(text, np.array(want))
    for a, b in zip(want, want[1:]):
        common = next((k for k, (x, y) in enumerate(zip(data[a:], data[b:])) if x != y), min(len(data) - a, len(data) - b))
        assert previous[b] == a and lengths[b] == common


def repeat_rows():
    passage = cases.prose(77, 30)
    texts = [r[1] for r in cases.rows()] + [
        f"{cases.prose(100 + k, 20)} {passage} {cases.prose(200 + k, 9)}" for k in range(6)
    ] + ["ab" * 90, "z" * 100, passage]
    return [(i if i % 5 else None, t, "en", "a", i) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeated_strings(spark, tmp_path, hot):
    data = repeat_rows()
    df = cases.settled(spark, cases.table(spark, data, extra=True), tmp_path)
    plan = repeats.Repeats(length=60, gram=20, shard_bytes=3000, hot=hot)
    got = repeats.remove_repeats(df, plan).collect()
    want = cases.repeats([r[1] for r in data], 60)
    assert multiset((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == multiset(
        (row[0], *w) for row, w in zip(data, want)
    )
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == r.n_spans
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed


def test_long_periodic_passages_are_no_shard(spark, tmp_path, monkeypatch):
    data = [(k, f"{cases.prose(k, 9)} {'z' * (900 + 40 * k)} {cases.prose(50 + k, 9)}", "en", "a", 0) for k in range(9)]
    df = cases.settled(spark, cases.table(spark, data), tmp_path)
    plan = repeats.Repeats(length=60, gram=20, shard_bytes=3000)
    dealt, sharded = [], repeats._sharded
    monkeypatch.setattr(repeats, "_sharded", lambda found, plan: (dealt.append(found), sharded(found, plan))[1])
    got = repeats.remove_repeats(df, plan).collect()
    want = cases.repeats([r[1] for r in data], 60)
    assert multiset((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == multiset(
        (row[0], *w) for row, w in zip(data, want)
    )
    groups = dealt[0].groupBy("gram").agg(F.sum(F.length("bytes")).alias("size")).collect()
    assert all(g["size"] <= plan.shard_bytes for g in groups)


def test_repeats_when_executors_come_and_go(spark, tmp_path):
    data = repeat_rows()
    path = str(tmp_path / "files.parquet")
    cases.table(spark, data).repartition(8).write.parquet(path)
    cores = "spark.sql.leafNodeDefaultParallelism"
    try:
        # Files are packed into partitions by the number of cores.
        spark.conf.set(cores, "2")
        cut = repeats.remove_repeats(spark.read.parquet(path), repeats.Repeats(length=60, gram=20, shard_bytes=3000))
        spark.conf.set(cores, "8")
        got = cut.collect()
    finally:
        spark.conf.unset(cores)
    want = cases.repeats([r[1] for r in data], 60)
    assert multiset((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == multiset(
        (row[0], *w) for row, w in zip(data, want)
    )


def test_repeats_of_nothing(empty):
    assert repeats.remove_repeats(empty).count() == 0


# exact copies

def test_exact_groups(docs, empty):
    groups = defaultdict(list)
    for r in cases.rows():
        groups[cases.SPACES.sub(" ", r[1] or "")].append(r[0])
    got = exact_dedup.exact_dedup(docs).collect()
    want = [
        (i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(text.encode()).hexdigest())
        for text, ids in groups.items() for i in ids
    ]
    assert multiset((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == multiset(want)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_colliding_hashes_are_told_apart(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00"))
    texts = {cases.SPACES.sub(" ", r[1] or "") for r in cases.rows()}
    got = exact_dedup.exact_dedup(docs).collect()
    assert sum(r.kept for r in got) == len(texts)
    assert {r.text_sha256: r.group_size for r in got} == {
        hashlib.sha256(t.encode()).hexdigest(): sum(cases.SPACES.sub(" ", r[1] or "") == t for r in cases.rows()) for t in texts
    }
    assert exact_dedup.first_copies(docs).count() == len(texts)


def test_first_copies_keep_columns(docs):
    kept = exact_dedup.first_copies(docs)
    assert kept.dtypes == docs.dtypes
    assert kept.count() == len({cases.SPACES.sub(" ", r[1] or "") for r in cases.rows()})


# mixing

def mixed_case():
    random.seed(3)
    return [
        (i, cases.prose(i, random.randint(0, 60)), "en", random.choice(["a"] * 12 + ["b", "c", None, "é"]), 0) for i in range(1500)
    ] + [(9000, cases.prose(3, 200), "en", "tiny", 0), (None, None, None, "void", None)]


def test_mix_meets_its_targets(spark, tmp_path):
    data = mixed_case()
    df = cases.settled(spark, cases.table(spark, data, extra=True), tmp_path)
    plan = mixing.Mix(shard_words=4000, bin_docs=50)
    got = mixing.taken_words(df, plan).collect()
    sizes = defaultdict(int)
    for r in data:
        sizes[r[3]] += len(cases.words(r[1]))
    want = cases.targets(sizes)
    assert multiset(r.size for r in got) == multiset(len(cases.words(r[1])) for r in data)
    of = {r[0]: r[3] for r in data}
    taken = defaultdict(int)
    for r in got:
        source = of[r.doc_id]
        assert r.target == pytest.approx(want[source]) and r.source_size == sizes[source]
        assert r.taken <= 3 * r.size
        taken[source] += r.taken
    for source, words in taken.items():
        biggest = max(len(cases.words(r[1])) for r in data if r[3] == source)
        assert abs(words - want[source]) <= biggest / 2 + sizes[source] / 2048 + 1
    assert multiset(got) == multiset(mixing.taken_words(df, plan).collect())


def test_shards_split_quotas_exactly():
    quotas = np.array([1000, 37, 0, 260])
    shards = 13
    leaves = [mixing._leaf_counts(quotas, k, shards, 5) for k in range(shards)]
    assert (sum(c for c, _ in leaves) == quotas).all()
    before = np.zeros(4, np.int64)
    for counts, first in leaves:
        assert (first == before).all()
        before += counts
    sizes = [int(c.sum()) for c, _ in leaves]
    assert max(sizes) - min(sizes) <= 1


def test_mixed_rows_repeat_documents(docs, empty):
    rows = mixing.mixed_rows(docs)
    assert rows.dtypes == docs.dtypes
    want = Counter()
    for r in mixing.taken_words(docs).where("size > 0").collect():
        want[r.doc_id] += r.taken // r.size
    got = Counter(r.doc_id for r in rows.where("text is not null").collect() if cases.words(r.text))
    assert got == +want
    assert mixing.mixed_rows(empty).count() == 0 and mixing.taken_words(empty).count() == 0


# urls

RULES = (
    url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"),
)


def test_urls(spark):
    urls = [
        ("http://a.NET/x", "a.net", "/x", "net/", "block"), ("https://b.example.net/en/1?q#f", "b.example.net", "/en/1", "example.net/en/", "allow"),
        ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("x://myexample.com/de/", "myexample.com", "/de/", None, "allow"),
        ("http://net", "net", "", None, "allow"), ("http://a.net?x=/y", "a.net", "", None, "allow"), (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"), ("a://b.net/c://d", "b.net", "/c://d", "net/", "block"), ("", "", "", None, "allow"),
        ("http://" + "a." * 5000 + "net/", "a." * 5000 + "net", "/", "net/", "block"),
    ]
    pages = spark.createDataFrame([(i % 4, u[0], "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.url_filter(pages, RULES).collect()
    assert multiset((r.host, r.path, r.rule, r.verdict) for r in got) == multiset(u[1:] for u in urls)
    assert url_filter.url_filter(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, ()).collect()} == {"allow"}


def test_colliding_digests_do_not_decide(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda data: 7)
    table = url_filter.digest_arrays(RULES)
    assert url_filter._judge(["a.net", "q.org"], ["/x", "/"], table) == (["net/", None], ["block", None])


# near copies

def near_rows():
    random.seed(11)
    out = list(cases.rows())
    for group in range(6):
        base = cases.prose(300 + group, 80).split()
        for k in range(9):
            copy = list(base)
            for _ in range(k % 4):
                copy[random.randrange(80)] = f"x{random.random()}"
            out.append((1000 + 10 * group + k, " ".join(copy) + ("" if k else " End"), "en", "a", 0))
    return out


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_components(spark, tmp_path, words, percent):
    data = near_rows()
    df = cases.settled(spark, cases.table(spark, data, extra=True), tmp_path)
    near = minhash.Near(words=words, percent=percent)
    got = minhash.near_groups(df, near).collect()
    roots = cases.near_components([r[1] for r in data], words, percent)
    least = {}
    for r, root in zip(data, roots):
        least[root] = min((x for x in (least.get(root), r[0]) if x is not None), default=None)
    want = [(r[0], len(cases.shingle_set(r[1], words)), least[root]) for r, root in zip(data, roots)]
    assert multiset((r.doc_id, r.n_shingles, r.component_id) for r in got) == multiset(want)
    assert sum(r.first for r in got) == len(set(roots))
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    kept = minhash.first_of_groups(df, near)
    assert kept.dtypes == df.dtypes and kept.count() == len(set(roots))


def test_near_copies_when_executors_come_and_go(spark, tmp_path, monkeypatch):
    data = near_rows()
    path = str(tmp_path / "files.parquet")
    cases.table(spark, data).repartition(8).write.parquet(path)
    near, cores, staged = minhash.Near(words=3, percent=85), "spark.sql.leafNodeDefaultParallelism", minhash.stage

    def grown(df, label):
        out = staged(df, label)
        if label == "signatures":
            spark.conf.set(cores, "8")
        return out

    monkeypatch.setattr(minhash, "stage", grown)
    roots = cases.near_components([r[1] for r in data], 3, 85)
    least = {}
    for r, root in zip(data, roots):
        least[root] = min((x for x in (least.get(root), r[0]) if x is not None), default=None)
    try:
        # Files are packed into partitions by the number of cores.
        spark.conf.set(cores, "2")
        got = minhash.near_groups(spark.read.parquet(path), near).collect()
        spark.conf.set(cores, "2")
        kept = minhash.first_of_groups(spark.read.parquet(path), near).collect()
    finally:
        spark.conf.unset(cores)
    assert multiset((r.doc_id, r.component_id) for r in got) == multiset((r[0], least[root]) for r, root in zip(data, roots))
    of_text = {r[1]: root for r, root in zip(data, roots) if r[1] and r[1].strip()}
    found = [of_text[r.text] for r in kept if r.text in of_text]
    assert len(kept) == len(set(roots)) and len(found) == len(set(found)) == len(set(of_text.values()))


def test_words_that_fool_sums_modulo_two_to_64():
    """Two words whose letters follow a Thue-Morse sequence and its complement hash alike modulo 2**64."""
    turn = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = "".join("ab"[t] for t in turn), "".join("ba"[t] for t in turn)
    assert len({int(v) for v in next(minhash.shingle_sets(pa.array([f"x y {a} x y {b}"]), 3))}) == 4
    made = [next(minhash.shingle_sets(pa.array([t]), 3)) for t in (f"x y {a}", f"x y {b}", f"x y {a}")]
    assert made[0][0] != made[1][0] and made[0][0] == made[2][0]


def test_range_hashes_are_exact_polynomials():
    data = np.random.default_rng(3).integers(0, 256, 3000, np.uint8)
    data[2000:2700] = data[100:800]
    sums = textbytes.prefix_sums(data)
    total, power = 0, 1
    for i, byte in enumerate(data.tolist()):
        total, power = (total + (byte + 1) * power) % textbytes.PRIME, power * textbytes.ROOT % textbytes.PRIME
        assert int(sums[i + 1]) == total
    one, other, short = textbytes.range_hashes(sums, np.array([100, 2000, 100]), np.array([800, 2700, 799]))
    assert one == other != short


def test_no_near_copies_in_nothing(empty):
    assert minhash.near_groups(empty).count() == 0


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
@settings(max_examples=4, deadline=None)
def test_star_components(edges):
    from tests.conftest import SESSION

    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components.components(SESSION.createDataFrame(edges, "a long, b long")).collect()
    assert multiset((r.node, r.root) for r in got) == multiset(root.items())


def test_pairs_that_meet_in_a_late_band_only_are_linked(spark, tmp_path):
    random.seed(5)
    core = [f"c{k}" for k in range(60)]
    data = []
    for i in range(150):
        own = [f"a{i}x{k}" for k in range(55)]
        data += [(2 * i, " ".join(core + own), "en", "a", 0), (2 * i + 1, " ".join(core + own[:18] + [f"b{i}x{k}" for k in range(37)]), "en", "a", 0)]
    df = cases.settled(spark, cases.table(spark, data), tmp_path)
    near = minhash.Near(words=1, percent=50, rows=3)
    signed = minhash.signatures(df.select(F.lit(0).cast("long").alias("at"), "doc_id", "text"), near).collect()
    bands = {r.doc_id: np.array(r.bands) for r in signed}
    sets = {r[0]: set(r[1].split()) for r in data}
    met = [i for i in range(0, 300, 2) if (bands[i] == bands[i + 1]).any()]
    late = [i for i in met if not (bands[i] == bands[i + 1])[:20].any()]
    assert len(late) > 3 and all(2 * len(sets[i] & sets[i + 1]) >= len(sets[i] | sets[i + 1]) for i in met)
    got = {r.doc_id: r.component_id for r in minhash.near_groups(df, near).collect()}
    assert [i for i in range(0, 300, 2) if got[i + 1] == i] == met
    assert all(got[i] == i for i in range(0, 300, 2))


# pages

def page(article: str, notice: str = "We use cookies", k: int = 0) -> str:
    return (
        f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body>"
        f"<header>Site</header><nav><ul><li><a href='/a'>Home {k}</a></li><li>More</ul></nav><!-- <p>no</p> --><div class='note-x'>{notice}</div>"
        f"<div class=\"ad top\">Buy {k}</div><article><h1>Head &amp; {k}</h1>{article}<aside>See also</aside><div id='comments'><p>First!</p></div></article>"
        "<form><p>Name</p></form><footer>&copy; x</footer>"
    )


def test_article_text():
    found = html_text.slots(page("<p>One\n  two<br>three<p><b>Four</b>&nbsp;<ul><li>five<li>six</ul>tail"), None)[2]
    assert [t for _, t in found] == ["Head & 0", "One two three", "Four\xa0", "five", "six", "tail"]


def test_wrapper_drops_constant_nodes(spark):
    plain = [page(f"<p>{cases.prose(k, 8)}</p>", k=k).replace("<article>", "<section>").replace("</article>", "</section>") for k in range(8)]
    data = [(k, f"http://h.org/{k}", h) for k, h in enumerate(plain)] + [
        (50, None, None), (51, "http://x.org/", ""), (0, "http://h.org/0", plain[0]), (52, "http://x.org/1", "<p>cut &am"), (None, "http://y.org", "<div>" * 3000 + "deep"),
    ]
    got = html_text.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(data) and all(r.n_chars == len(r.text) for r in got)
    for k in range(8):
        assert text[k] == f"Head & {k}\n\n{cases.prose(k, 8)}"
    assert text[50] == "" and text[51] == "" and text[52] == "cut &am" and text[None] == "deep"


def test_small_hosts_have_no_template(spark):
    one = page("<p>Body</p>").replace("<article>", "<section>").replace("</article>", "</section>")
    got = html_text.main_text(spark.createDataFrame([(1, "http://h.org/", one)], "page_id long, url string, html string")).first()
    assert got.text == "We use cookies\n\nHead & 0\n\nBody"
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page,want", [
    ("<div><h1>Head</h1><p>Text</p></div><div id=comments><article>Mine</article></div><aside><article>Teaser</article></aside>", ["Head", "Text"]),
    ("<div id=page class='no-sidebar'><article><h1>Head</h1>Text</article></div>", ["Head", "Text"]),
    ("<div class='page sidebar'><article><h1>Head</h1>Text</article></div><p>Imprint", ["Head", "Text"]),
    ("<div class=sidebar><article>Text</article></div>", ["Text"]),
    ("<div class=social><main>Text</main></div><div class=related><article>Teaser</article></div>", ["Text"]),
    ("<form id=page><div><article>Text</article></div></form>", ["Text"]),
    ("<article>Text</article><article class='comment'>Mine</article>", ["Text"]),
    ("<article>Text<article class='comment odd'>Mine</article></article>", ["Text"]),
    ("<article class='social'><h1>Head</h1>Text</article>", ["Head", "Text"]),
    ("<div><p>Text</div><article class=comment>Mine</article>", ["Text"]),
    ("<main></main><div>Text</div>", ["Text"]),
    ("<div class=post-comments>Mine</div><div class=related_posts>More</div><div class=cookie-banner>Ok</div><div class='advert-box x'>Buy</div><p>Text", ["Text"]),
    ("<div class='has-comments comment-count'>Text</div><div class=page-header><h1>Head</h1></div>", ["Text", "Head"]),
    ("<div class=related-posts><article>Text</article></div>", ["Text"]),
    ("<div class='no sidebar'>Menu</div><div class=no-sidebar>Text</div>", ["Text"]),
])
def test_main_text_does_not_vanish(page, want):
    assert [t for _, t in html_text.slots(page, None)[2]] == want


def test_copies_of_an_article_are_one_page(spark):
    data = [
        (k, f"http://h.org/a?session={k}", f"<nav>Item {k}</nav><div>Read {k} times</div><article><h1>Head</h1><p>{cases.prose(3, 9)}</article><div class=ad>Buy {k}</div>")
        for k in range(12)
    ] + [(k, f"http://i.org/a?session={k}", f"<nav>Item {k}</nav><div><p>{cases.prose(4, 9)}</div><div class=ad>Buy {k}</div>") for k in range(20, 30)]
    text = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert text == {k: f"Head\n\n{cases.prose(3, 9)}" if k < 20 else cases.prose(4, 9) for k, _, _ in data}


def test_every_layout_of_a_host_has_its_template(spark):
    def first(k):
        return f"<div class=a><p>Constant one</p></div><section><p>{cases.prose(k, 8)}</p></section>"

    def second(k):
        return f"<table><tr><td>Constant two</table><div class=b><p>{cases.prose(k, 9)}</p>{'<ul><li>' + cases.prose(k, 3) + '</ul>' if k == 27 else ''}</div>"

    data = [(k, f"http://h.org/{k}", first(k)) for k in range(8)] + [(k, f"http://h.org/{k}", second(k)) for k in range(20, 28)]
    data += [(100 + k, f"http://h.org/{k}", None if k % 2 else "") for k in range(40)]
    for seed in range(3):
        moved = [(i, u, h and h + "<!-- -->" * seed) for i, u, h in data]
        text = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(moved, "page_id long, url string, html string")).collect()}
        assert [text[k] for k in range(8)] == [cases.prose(k, 8) for k in range(8)]
        assert [text[k] for k in range(20, 27)] == [cases.prose(k, 9) for k in range(20, 27)]
        assert text[27] == f"{cases.prose(27, 9)}\n\n{cases.prose(27, 3)}"
        assert all(text[100 + k] == "" for k in range(40))


def test_tree_matching_is_the_largest():
    a, b = (html_text.fold(html_text.parse(t)) for t in ("<ul><li>x</ul><p>a</p><table><tr><td>q</table>", "<p>b</p><div>n</div><table><tr><td>r</table>"))
    assert [x.label for x, _ in html_text.align(a, b)] == ["", "table", "tr", "td", "p"]


# encoding

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def test_ids_equal_the_library(docs, empty, library):
    got = bpe.encode_documents(docs, TOKENIZER, bpe.Lexicon(size=50)).collect()
    want = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in cases.rows()]
    assert multiset((r.doc_id, list(r.ids)) for r in got) == multiset(want)
    assert multiset(r.decoded for r in got) == multiset(library.decode(ids, skip_special_tokens=False) for _, ids in want)
    assert bpe.encode_documents(empty, TOKENIZER).count() == 0


def test_decode_alone(spark, library):
    df = spark.createDataFrame([(1, [31373, 995]), (2, []), (3, None), (4, [50256, 447])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, TOKENIZER).collect()}
    assert got == {1: "hello world", 2: "", 3: "", 4: library.decode([50256, 447], skip_special_tokens=False)}


@given(st.text(alphabet="ab cé's\n\t\u00a0\u3000\u1680²½漢🙂'RE1_<|endoftext|>\x1c\x85", max_size=40))
@settings(max_examples=300, deadline=None)
def test_splitting_and_merging(text):
    rules, library = bpe.merger(TOKENIZER), Tokenizer.from_file(TOKENIZER) if not hasattr(test_splitting_and_merging, "lib") else test_splitting_and_merging.lib
    test_splitting_and_merging.lib = library
    ids = [i for w in bpe.split_words(text, rules.specials) for i in ([rules.specials[w]] if w in rules.specials else rules.ids(w.encode()))]
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_long_words_merge_alike(library):
    for word in ("x" * 3000, "ab" * 1000, "aaab" * 40 + "z"):
        assert bpe.merger(TOKENIZER).ids(word.encode()) == library.encode(word, add_special_tokens=False).ids


@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(min_size=1, max_size=6), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_transducer_numbers_words(stored, asked):
    ordered = sorted(stored)
    probes = ordered + asked
    got = bpe.word_numbers(bpe.compile_words(ordered), probes).tolist()
    assert got == [ordered.index(w) if w in stored else -1 for w in probes]


# ordinal regression

def graded(n: int, seed: int):
    random.seed(seed)
    out = []
    for i in range(n):
        grade = random.choice((0, 1, 2, 2))
        own = [f"w{random.randrange(3000)}" for _ in range(60)]
        if grade == 0:
            own[7] = "Vile" + random.choice("xyz") + ("!" if i % 2 else "")
        if grade == 1:
            own = [w + "###" if k % 3 else w for k, w in enumerate(own)]
        out.append((i, " ".join(own), grade))
    return out


def test_held_out_grades(spark):
    data = graded(1200, 4)
    df = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in data[:800]] + [(None, 1), (3, None), (800_000, 2)], "doc_id long, grade int")
    got = {r.doc_id: r for r in ordinal.score(df, ordinal.train(df, labels)).collect()}
    held = data[800:]
    assert sum(got[i].kept == (g == 2) for i, _, g in held) >= 0.97 * len(held)
    means = [np.mean([got[i].expected_grade for i, _, g in held if g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())


def test_scores_of_awkward_rows(docs, empty, spark):
    labels = spark.createDataFrame([(0, 2), (0, 1), (1, 0), (2, 1)], "doc_id long, grade int")
    model = ordinal.train(docs, labels)
    got = ordinal.score(docs, model).collect()
    assert multiset(r.doc_id for r in got) == multiset(r[0] for r in cases.rows())
    assert ordinal.score(empty, model).count() == 0
    nothing = ordinal.train(empty, labels)
    assert {r.score for r in ordinal.score(docs, nothing).collect()} == {0.0}


# licenses

def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=14))
@settings(max_examples=200, deadline=None)
def test_patience_is_an_alignment(a, b):
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))
    assert len(pairs) <= plain_lcs(a, b)
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        assert len(pairs) == plain_lcs(a, b)


def test_notices_are_found(spark):
    mit = next(n.text for n in licenses.NOTICES if n.license == "MIT" and len(n.text) > 500)
    worn = mit.replace("free of charge, ", "free of\ncharge, ").replace("sell copies", "trade copies")
    data = [
        (1, f"{cases.prose(1, 900)}\nReleased under the MIT License.\n{cases.prose(2, 50)}"), (2, f"// {worn}"), (3, "mit der license"), (4, None), (5, ""),
        (6, "Licensed under CC BY-NC 4.0."), (6, "Licensed under CC BY-NC 4.0."), (None, "This work is licensed under the GNU General Public License, version 3."),
        (7, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (8, "released under the bsd license"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, matches string")
    got = [(r.doc_id, [(m.license, m.coverage) for m in r.matches]) for r in licenses.scan_licenses(df).collect()]
    want = {1: ["MIT"], 2: ["MIT"], 3: [], 4: [], 5: [], 6: ["CC-BY-NC-4.0"], None: ["GPL-3.0"], 7: ["Apache-2.0", "MIT"], 8: []}
    assert len(got) == len(data)
    for i, matches in got:
        assert [m[0] for m in matches] == want[i], (i, matches)
    texts = dict(data)
    for r in licenses.scan_licenses(df).where("size(matches) = 1 and doc_id = 1").collect():
        assert texts[1][r.matches[0].start:r.matches[0].stop] == "Released under the MIT License"
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_rows_of_one_id_count_once_in_the_fit(spark, tmp_path):
    rows = [(1, "good words here", "en", "s", 1)] * 300 + [(2, "bad stuff there", "en", "s", 2), (3, "good things again", "en", "s", 3)]
    labels = spark.createDataFrame([(1, 2), (2, 0), (3, 2)], "doc_id long, grade int")
    often = ordinal.train(cases.settled(spark, cases.table(spark, rows), tmp_path), labels)
    once = ordinal.train(cases.settled(spark, cases.table(spark, rows[299:]), tmp_path), labels)
    assert all(np.array_equal(often[k], once[k]) for k in once)
