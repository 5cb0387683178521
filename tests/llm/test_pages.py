"""Archives, sharding, urls and the classifier."""

import gzip
import hashlib
import io
import itertools
import random
import time

import duckdb
import numpy as np
import pytest

from caseweave.llm import quality_classifier, sharding, url_filter, warc

DICE = random.Random(5)
LONG = "x" * 50_000 + "".join(chr(DICE.randint(32, 0x2FF)) for _ in range(200_000))
PAGES = [(3, "http://a/ b\n", "y" * 200), (1, "http://a", "y" * 200), (2, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", LONG), (8, "u", LONG), (8, "u", LONG), (None, "u", "z" * 100)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(k, u, h, "clash") for k, u, h in rows], "page_id bigint, url string, html string, digest string")


def test_archives_round_trip(spark):
    want = []
    for key, _, html in PAGES:
        data = (html or "").encode()
        least = min((k for k, _, h in PAGES if k is not None and (h or "") == (html or "")), default=None) if len(data) >= 100 else key
        want.append((f"urn:x-page:{'' if key is None else key}", len(data), "response" if least == key or least is None else "revisit", hashlib.sha256(data).hexdigest()))
    for split in (1 << 25, 5000, 64):
        out = warc.read_warc(warc.write_warc(pages(spark), file_bytes=100_000), split).collect()
        got = [(r.record_id, r.http_length, r.record_type, r.digest.removeprefix("sha256:")) for r in out]
        assert sorted(got) == sorted(want)
        for r in out:
            if r.record_type == "response":
                assert hashlib.sha256(r.payload).hexdigest() == r.digest.removeprefix("sha256:")
    assert warc.read_warc(warc.write_warc(pages(spark, []))).count() == 0


def test_archive_inside_a_payload_is_no_record():
    inner = b"".join(warc.member(warc.as_record(100 + i, "inner", b"i" * 300, "0", None)) for i in range(5))
    records = [warc.as_record(i, "outer", inner, "0", None) for i in range(3)]
    level, warc.LEVEL = warc.LEVEL, 0  # stored as it is, so the inner magics stand in the file
    try:
        data = b"".join(map(warc.member, records))
    finally:
        warc.LEVEL = level
    assert data.count(warc.MAGIC) > 3
    starts = []
    for begin in range(0, len(data), 97):
        starts += warc.Members(io.BytesIO(data), len(data)).owned(begin, min(begin + 97, len(data)))
    size = len(data) // 3
    true = [0, len(warc.member(records[0]))]
    assert set(starts) >= {0}
    whole = warc.Members(io.BytesIO(data), len(data)).owned(0, len(data))
    assert len(whole) == 3 and whole[0] == true[0]
    half = warc.Members(io.BytesIO(data), len(data)).owned(50, len(data))
    assert half == whole[1:]
    assert size > 0


def test_broken_archive_is_an_error():
    data = warc.member(warc.as_record(1, "u", b"p" * 5000, "0", None))
    with pytest.raises(ValueError):
        warc.Members(io.BytesIO(data[:-20]), len(data) - 20).owned(0, len(data) - 20)
    plain = gzip.compress(b"no archive at all")
    with pytest.raises(ValueError):
        warc.Members(io.BytesIO(plain), len(plain)).owned(0, len(plain))


@pytest.mark.parametrize("damage", ["cut off", "padded", "within", "between"])
def test_archive_broken_after_the_first_range_is_an_error(damage):
    """The range that holds the record before the break reports it, whichever range that is."""
    dice = random.Random(3)
    members = [warc.member(warc.as_record(i, "u", dice.randbytes(3000), "0", None)) for i in range(8)]
    if damage == "cut off":
        members[-1] = members[-1][:-20]
    elif damage == "padded":
        members.append(b"\0" * 100)
    elif damage == "within":
        members[5] = members[5][:1500] + b"\0" * 100 + members[5][1600:]
    else:
        members.insert(5, b"junk")
    data = b"".join(members)
    first = len(members[0]) + 1  # in no case does the break touch the first range
    ends = sorted({first, *range(first, len(data), 7000), len(data)})
    errors = 0
    for begin, end in zip([0, *ends], ends):
        try:
            warc.Members(io.BytesIO(data), len(data)).owned(begin, end)
        except ValueError:
            errors += 1
    assert errors
    with pytest.raises(ValueError):
        warc.Members(io.BytesIO(data), len(data)).owned(first, len(data))


def test_lookup_table():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    counts = np.bincount(table)
    assert len(counts) == 7 and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.15 * 1009
    for bad in (([], 7), (["a", "a"], 7), (["a", "b"], 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (2, "x")], "doc_id bigint, shard string")
    out = sharding.place(rows, "doc_id", ["a", "b"], 11).collect()
    assert len(out) == 4 and all(r.shard in "ab" for r in out)
    table = sharding.lookup_table(["a", "b"], 11)
    for r in out:
        slot = sharding.text_hash("null" if r.doc_id is None else str(r.doc_id)) % 11
        assert (r.slot, r.shard) == (slot, "ab"[table[slot]])
    assert sharding.place(rows.limit(0), "doc_id", ["a"], 11).count() == 0


URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/2", "http://x.com/fr", "http://x.com", "HTTP://Q.Net/es/1?x#y", "http://net/fr/", "http://net/frx", "http://internet/es/", None, "no scheme",
    "http://u@h.org:80?q=/a", "a://b://c/d", "://#", "http://goodnews.org/en/7", "http://goodnews.org/en/7", "http://" + "a" * 300 + ".org/x",
]


def verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, None
    n = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, tail = rest[:n].lower(), rest[n:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_urls(spark):
    rows = spark.createDataFrame([(i, u, "good news good news for a " * 3 if i % 2 else None, "clash") for i, u in enumerate(URLS)], "page_id bigint, url string, html string, host string")
    out = {r.page_id: r for r in url_filter.filter_urls(rows).collect()}
    for i, url in enumerate(URLS):
        host, path, rule, listed = verdict(url)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict == (listed or out[i].verdict) and out[i].verdict in ("allow", "block")
    assert url_filter.filter_urls(rows.limit(0)).count() == 0


def test_segmentation():
    counts = {"good": 50, "news": 40, "go": 10, "od": 1, "goodnews": 1}
    assert url_filter.best_split("goodnews", counts, 1000.0) == ["good", "news"]
    assert "".join(url_filter.best_split("zzgoodqq", counts, 1000.0)) == "zzgoodqq"
    assert url_filter.best_split("", counts, 1000.0) == []


def test_markup_is_no_text_and_hyphens_part_words(spark):
    html = "<!-- pills --><style>li {casino: win}</style><ul><li><a href='x'>Casino &amp; win</a></li></ul><script type='a'>track(ads)</script><p>ads, track bets free cheap < 3 </p>"
    counts = url_filter.word_counts(spark.createDataFrame([(html,), (None,), ("casino win",)], "html string"), "html")
    assert {r.word: r.n for r in counts.collect()} == {"casino": 2, "win": 2, "ads": 1, "track": 1, "bets": 1, "free": 1, "cheap": 1, "3": 1}
    hosts = spark.createDataFrame([(h,) for h in ("casino-win.ads-track.com", "freebets", "cheap--pills.", "...", "a" * 100_000 + ".casinowin")], "host string")
    out = {r.host: r.words for r in url_filter.host_words(hosts, counts).collect()}
    assert out["casino-win.ads-track.com"] == ["casino", "win", "ads", "track", "com"]
    assert out["freebets"] == ["free", "bets"] and out["cheap--pills."] == ["cheap", "pills"]
    assert "..." not in out and out["a" * 100_000 + ".casinowin"] == ["a" * 100_000, "casino", "win"]


def test_long_labels_take_linear_time():
    began = time.process_time()
    label = "goodnews" * 6_000 + "q" * 52_000
    assert url_filter.best_split(label, {"good": 50, "news": 40}, 1000.0) == ["good", "news"] * 6_000 + ["q" * 52_000]
    assert time.process_time() - began < 1.5


def test_split_is_the_best_of_all():
    counts = {w: DICE.randint(1, 50) for w in ("a", "ab", "ba", "abc", "cab", "bca", "cc")}
    cost = lambda w: np.log(300 / counts[w]) if w in counts else np.log(300) + len(w) * np.log(10)
    for _ in range(60):
        label = "".join(DICE.choice("abc") for _ in range(DICE.randint(1, 9)))
        ways = [[label[i:j] for i, j in zip((0, *cut), (*cut, len(label)))] for n in range(len(label)) for cut in itertools.combinations(range(1, len(label)), n)]
        got = url_filter.best_split(label, counts, 300.0)
        assert "".join(got) == label
        assert sum(map(cost, got)) <= min(sum(map(cost, w)) for w in ways) + 1e-9


def test_long_and_accented_words_are_known(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    assert url_filter.best_split(long, {long: 5, "schiff": 9}, 100.0) == [long]
    assert url_filter.best_split("q" * 30, {}, 100.0) == ["q" * 30]
    texts = spark.createDataFrame([(f"Die {long.upper()}, café-société; 東京 e\u0301te {'w' * 70} " * 4,)], "html string")
    counts = url_filter.word_counts(texts, "html")
    assert {r.word: r.n for r in counts.collect()} == {w: 4 for w in ("die", long, "café", "société", "東京", "e\u0301te", "w" * 70)}
    labels = ["meine" + long, "cafésociété", "東京", "die" + "w" * 70]
    out = {r.label: r.words for r in url_filter.label_words(spark.createDataFrame([(x,) for x in labels], "label string"), counts).collect()}
    assert out == {labels[0]: ["meine", long], labels[1]: ["café", "société"], "東京": ["東京"], labels[3]: ["die", "w" * 70]}


def test_bayes_learns_paths(spark):
    rows = [(i, f"http://h{i % 7}.org/{'spam' if i % 2 else 'ham'}/{i}") for i in range(40)]
    rules = [("block", f"h{k}.org", "/spam/") for k in range(5)] + [("allow", f"h{k}.org", "/ham/") for k in range(5)]
    out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), rules, text=None).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in out)
    assert any(r.rule is None for r in out)


def test_bayes_counts_every_token_by_itself(spark):
    """Log odds against exact counts; tokens that no example has keep to themselves."""
    urls = [f"http://h{i % 7}.org/{DICE.choice(['spam', 'ham', 'x'])}/t{DICE.randint(0, 60)}/" for i in range(150)] + [None, "http://new.net/unseen"]
    rules = [("block", f"h{k}.org", "/spam/") for k in range(5)] + [("allow", f"h{k}.org", "/ham/") for k in range(4)]
    rows = spark.createDataFrame([(i % 140, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    counts, words = {}, {}
    classes = {"block": 0, "allow": 0}
    out = url_filter.filter_urls(rows, rules, text=None).collect()
    split = {label: url_filter.best_split(label, {}, 1.0) for label in [f"h{k}" for k in range(7)] + ["org", "new", "net"]}
    for url in urls:
        host, path = url.split("/", 3)[2:] if url else ("", "")
        words[url] = [f"h:{w}" for label in host.split(".") if label for w in split[label]] + [f"p:{p}" for p in path.split("/") if p]
        listed = next((v for v, h, p in rules if h == host and f"/{path}".startswith(p)), None)
        if listed:
            classes[listed] += 1
        for token in words[url]:
            counts.setdefault(token, {"block": 0, "allow": 0})
            if listed:
                counts[token][listed] += 1
    total = {c: sum(n[c] for n in counts.values()) + len(counts) for c in classes}
    odds = {t: np.log((n["block"] + 1) / total["block"]) - np.log((n["allow"] + 1) / total["allow"]) for t, n in counts.items()}
    want = [np.log((classes["block"] + 1) / (classes["allow"] + 1)) + sum(odds[t] for t in words[u]) for u in urls]
    assert np.allclose(sorted(r.block_odds for r in out), sorted(want))
    assert all(r.rule or r.verdict == ("block" if r.block_odds > 0 else "allow") for r in out)


def test_vectors_are_finite():
    for text in (None, "", " \n", "a", "\n\n", "ÉÀ 日本", LONG):
        assert np.isfinite(quality_classifier.statistics(text)).all()


def test_discriminant_against_densities():
    dice = np.random.default_rng(2)
    groups = [dice.normal(0, 1, (400, 3)), dice.normal(2, 0.5, (300, 3))]
    model = quality_classifier.discriminant([len(g) for g in groups], [g.sum(0) for g in groups], [g.T @ g for g in groups])
    pooled = sum(len(g) * np.cov(g.T, bias=True) for g in groups) / 700
    pooled = 0.98 * pooled + 0.02 * np.eye(3) * np.trace(pooled) / 3
    logs = []
    for g in groups:
        cov = 0.8 * np.cov(g.T, bias=True) + 0.2 * pooled
        gap = groups[1][:5] - g.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.log(np.linalg.det(cov)))
    logit = quality_classifier.TEMPER * (logs[1] - logs[0]) + np.log(301 / 401)
    assert np.allclose(model.scores(groups[1][:5]), 1 / (1 + np.exp(-logit)))


def test_classifier(spark):
    junk = ["A!! B!! C!!" * 9, "a | b | c | " * 9, "one*** two&&& " * 9, "se se se se " * 20]
    clean = ["The old man went to the sea, and it was good.\nHe came back later. ", "A short note about rivers and hills. ", "Words follow words in lines of prose, now and then. "]
    rows = [(i, (clean[i % 3] if i % 2 else junk[i // 2 % 4]) * (1 + i % 5), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(1000, None, 0.5), (1001, "", 0.5)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1000, None), (None, 1), (5000, 1)], "doc_id bigint, quality int")
    out = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(out) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    held = [(out[i].predicted, q) for i, _, q in rows if out[i].held_out]
    assert 60 < len(held) < 140 and np.mean([p == q for p, q in held]) > 0.97
    assert out[1000].score == out[1001].score
    kept = quality_classifier.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted}
    unlabelled = quality_classifier.classify(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in unlabelled] == [0.5]
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_shard_sql(spark, tmp_path):
    from caseweave.llm import queries

    spark.range(200).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, slot, shard FROM ({queries.SHARD_SQL})").fetchall())
    assert sorted(tuple(r) for r in queries.op5_shard_documents(spark, str(tmp_path)).collect()) == want
