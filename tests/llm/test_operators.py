"""The operators that have no test file of their own, against brute force, round trips and held-out labels."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import langid, queries, quality_gam, spotsigs, substring_fm, toxicity_crf, warc, weak_rules

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (None, "word " * 4000), (6, "a b c\na b c\nx # y"), (7, "Ünï çødé 😀 text")]


def odd(spark):
    return spark.createDataFrame([(i, t, "extra") for i, t in ODD], "doc_id long, text string, id string")


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>" + "x" * 2000 + "</p>", "short", None, "é" * 600]
    rows = [(k, f"http://h/{k}\r\nA: b é", html[k % 4], "z") for k in range(40)] + [(None, None, html[0], "z"), (39, None, html[3], "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id string")
    manifest = warc.archive(pages.repartition(3), f"file://{tmp_path}/a")
    assert sum(r.records for r in manifest.collect()) == len(rows)
    for split in (97, 1000, 1 << 24):
        got = warc.digests(warc.read(manifest, split)).collect()
        assert len(got) == len(rows)
        want = Counter()
        for page, _, text, _ in rows:
            payload = (text or "").encode()
            first = {0: 36, 3: 39}.get(html.index(text)) if len(payload) >= 1000 else None
            later = first is not None and page != first
            want[page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if later else "response", first if later else None] += 1
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.archive(pages.limit(0), f"file://{tmp_path}/b").count() == 0


def test_warc_long_urls(spark, tmp_path):
    import random

    rng = random.Random(8)
    urls = ["http://h/" + "x" * 70_000, "http://h/" + "é" * 22_000, "http://h/" + "".join(rng.choice("abcdefghijklmnop0123456789") for _ in range(2_500_000)), "http://h/short"]
    rows = [(k, urls[k % 4], f"<p>{k}</p>") for k in range(12)]
    manifest = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}/a")
    for split in (100_000, 1 << 24):
        got = warc.digests(warc.read(manifest, split)).collect()
        assert sorted((r.page_id, len(r.target)) for r in got) == [(k, len(u.replace("é", "%C3%A9"))) for k, u, _ in rows]


def test_warc_damage_is_no_silent_loss(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "<p>" + "y" * 50) for k in range(30)], "page_id long, url string, html string")
    manifest = warc.archive(pages.coalesce(1), str(tmp_path / "a")).collect()
    path = manifest[0]["path"].removeprefix("file://")
    data = open(path, "rb").read()
    import io

    want = [at for at, _ in warc.scan(io.BytesIO(data), len(data), 0, len(data))]
    assert len(want) == 30
    broken = data[: want[12] + 1] + b"\x00" * 20 + data[want[12] + 21 :]
    for split in (50, 400, len(data)):
        with pytest.raises(ValueError):
            for a in range(0, len(data), split):
                list(warc.scan(io.BytesIO(broken), len(data), a, min(len(data), a + split)))


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op4_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    model = langid.fit([("aa", "abab abba baab"), ("cc", "cdcd dccd")])
    out = langid.identify(odd(spark), model, ["doc_id"]).collect()
    assert [r.lang_pred for r in out if r.carried.doc_id in (1, 2, 3)] == ["und"] * 3 and len(out) == len(ODD)
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.Parser(langid.fit([])).predict(["x"])[0] == ["und"]
    odd_names = spark.createDataFrame([(1, "abab", "a", 2.0, "b")], "doc_id long, text string, lang_pred string, score double, carried string")
    assert langid.identify(odd_names, model, odd_names.columns).select("carried.*").collect() == odd_names.collect()


def parsed(text, ref):
    """Phrases by plain search."""
    n, phrase = 1, ""
    for c in text:
        if phrase + c in ref:
            phrase += c
        else:
            n, phrase = n + 1, c if c in ref else ""
    return n


def test_language_phrases_are_those_of_one_parse(monkeypatch):
    import random

    rng = random.Random(1)
    say = lambda n: "".join(rng.choice("abbcc  d") for _ in range(n))
    refs = {"aa": say(300), "bb": say(50) + "ü", "cc": "x"}
    model = langid.fit(list(refs.items()))
    texts = [say(n) for n in (1, 4, 5, 6, 30, 31, 400, 1000)] + [None, "", " ", "abc" * 70, "x" * 33, "zzüz" * 9, " a. b?! ", "7 ab 7"]
    for piece in (1, 2, 5, 256):
        monkeypatch.setattr(langid, "PIECE", piece)
        got, n = langid.Parser(model).phrases(texts)
        for t, row, size in zip(texts, got, n, strict=True):
            plain = langid._plain(t or "")
            assert len(plain) == size
            plain = "".join(c if c == " " or c in model.letters else "?" for c in plain)
            assert not plain or row.tolist() == [parsed(plain, " " + langid._plain(refs[k])) for k in model.langs]


def test_language_sample(spark):
    rows = [(k, "en", "word " * k) for k in range(1, 9)] + [(20, "de", "wort " * 50), (21, "fr", "mot " * 200), (22, None, "none"), (23, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = Counter(k for k, _ in langid.training_rows(docs, docs.doc_id > 0, per_language=4, longest=20, most=300))
    assert got == {"en": 4, "de": 1}  # short ones first, whole; the only French text is too long
    assert all(t in {r[2] for r in rows} for _, t in langid.training_rows(docs, docs.doc_id > 0))
    assert langid.training_rows(docs.limit(0), docs.doc_id > 0) == []


def test_language_beside_a_tiny_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.training_rows(docs, langid.fold(docs["doc_id"], 5) != 0)
    texts = [r.text for r in docs.select("text").collect()]
    alone = langid.fit(rows)
    want, _ = langid.Parser(alone).predict(texts)
    for tiny in ("a", "the", "zq zq"):
        model = langid.fit([*rows, ("xx", tiny)])
        of = {k: t.base.size for k, t in zip(model.langs, model.tables, strict=True)}
        assert all(of[k] >= t.base.size for k, t in zip(alone.langs, alone.tables, strict=True))
        got, _ = langid.Parser(model).predict(texts)
        assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.99 * len(texts)


def test_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op3_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in got) / len(got) > 0.93
    x = quality_gam.matrix([t.encode() if t is not None else None for _, t in ODD])
    gam = quality_gam.fit(np.vstack([x] * 5), np.array([0, 1, 0, 1, 0, 1, 1, 0] * 5, float))
    assert ((gam.score(x) >= 0) & (gam.score(x) <= 1)).all()
    assert quality_gam.Gam().score(x) == pytest.approx(np.full(len(ODD), 0.5))
    assert quality_gam.assess(odd(spark), gam, ["doc_id"]).count() == len(ODD)
    # A score is the sum of the tables' entries of its bins, feature by feature and pair by pair.
    for row, value in zip(x, gam.score(x), strict=True):
        at = [int(np.searchsorted(edges, v, "right")) for edges, v in zip(gam.edges, row, strict=True)]
        total = gam.base + sum(float(table[k]) for table, k in zip(gam.mains, at, strict=True))
        total += sum(float(table[int(gam.coarse[i][at[i]]), int(gam.coarse[j][at[j]])]) for (i, j), table in gam.pairs.items())
        assert value == pytest.approx(1 / (1 + np.exp(-total)))


def test_toxicity(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op9_toxicity(spark, SF).join(labels, "doc_id").collect()
    assert sum(r.predicted for r in got if not r.toxic) == 0
    assert sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got) > 0.6
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got:
        for s in r.spans:
            assert docs[r.doc_id][s["first"] : s["last"]].strip() == docs[r.doc_id][s["first"] : s["last"]] != ""
    crf = toxicity_crf.fit([], np.zeros(0))
    assert [r.score < 0.1 for r in toxicity_crf.score(odd(spark), crf, ["doc_id"]).collect()] == [True] * len(ODD)


def test_marginals_are_exact(monkeypatch):
    rng = np.random.default_rng(1)
    sizes, step = np.array([5, 0, 1, 10, 9]), rng.normal(size=(2, 2))
    e, start = rng.normal(size=int(sizes.sum())), 0
    want = []
    for n in sizes.tolist():
        own, total, on = e[start : start + n], 0.0, np.zeros(n)
        for k in range(2**n):
            y = [k >> j & 1 for j in range(n)]
            w = np.exp(sum(own[j] * y[j] for j in range(n)) + sum(step[y[j], y[j + 1]] for j in range(n - 1)))
            total += w
            on += w * np.array(y)
        want += (on / total).tolist()
        start += n
    for piece in (1, 2, 3, 4, 5, 64):
        monkeypatch.setattr(toxicity_crf, "PIECE", piece)
        assert toxicity_crf.marginals(e, step, toxicity_crf.Chains(sizes))[0] == pytest.approx(np.array(want))


def test_marginals_of_long_texts(monkeypatch):
    rng = np.random.default_rng(2)
    sizes, step = np.array([70, 64, 3000, 63, 1, 129]), np.array([[2.0, -3.0], [-3.0, 3.0]])
    e = rng.normal(-1, 3, int(sizes.sum()))
    got, odds = toxicity_crf.marginals(e, step, toxicity_crf.Chains(sizes))
    monkeypatch.setattr(toxicity_crf, "PIECE", 4000)
    want, whole = toxicity_crf.marginals(e, step, toxicity_crf.Chains(sizes))
    assert got == pytest.approx(want) and odds == pytest.approx(whole)


def test_toxic_words_are_seen_whole():
    long = "x" * 60
    assert toxicity_crf.parts(long + "kill") != toxicity_crf.parts(long + "fine")
    assert toxicity_crf.parts("!" * 20 + "a")[0] == "wa" and len(set(map(tuple, (toxicity_crf.parts("!" * k) for k in range(13, 50))))) == 37
    # A word after 64 others is toxic beside another one: the chain goes on.
    crf = toxicity_crf.Crf({"wbad": 4.0, "wworse": 9.0}, -6.0, np.array([[1.0, -1.0], [-1.0, 1.0]]), (-2.0, 4.0, 0.0))
    apart, together = "fine " * 63 + "worse fine bad", "fine " * 63 + "worse bad"
    p = [toxicity_crf.Tagger(crf).probabilities([t])[0] for t in (apart, together)]
    assert p[1][-1] > 2 * p[0][-1]


def test_toxic_odd_rows(spark):
    docs = [f"nice words number {k} here" if k % 2 else f"nice words zorgish{k % 3} here {k}" for k in range(60)]
    crf = toxicity_crf.fit(docs, np.array([k % 2 == 0 for k in range(60)], float))
    texts = [t for _, t in ODD] + ["a zorgish1 b", "word " * 30_000 + "zorgish2 end", "fine"]
    frame = spark.createDataFrame([(k, t, "x", 1.0, [1]) for k, t in enumerate(texts)], "doc_id long, text string, spans string, score double, carried array<int>")
    got = {r.carried.doc_id: r for r in toxicity_crf.score(frame, crf, frame.columns).collect()}
    assert len(got) == len(texts) and len({got[k].score for k in (0, 1, 2)}) == 1
    n = len(ODD)
    assert got[n].score > 0.7 and got[n + 1].score > 0.7 and got[n + 2].score < 0.3
    assert [(s["first"], s["last"]) for s in got[n + 1].spans] == [(150_000, 150_008)] and not got[n + 2].spans
    # Scores are those of the words' probabilities, by the plain recursion.
    t = np.exp(crf.step)
    for k, text in enumerate(texts):
        words = (text or "").lower().split()
        if not 0 < len(words) < 50:
            continue
        x = np.exp([crf.emission(w) for w in words])
        a, b = [np.array([1.0, x[0]])], [np.ones(2)]
        for y in x[1:]:
            a.append(a[-1] @ t * np.array([1.0, y]))
        for y in x[:0:-1]:
            b.insert(0, t @ (np.array([1.0, y]) * b[0]))
        p = [(u * v)[1] / (u * v).sum() for u, v in zip(a, b, strict=True)]
        z = crf.head[0] + crf.head[1] * max(p) + crf.head[2] * np.log1p(sum(q for q in p if q >= 0.1))
        assert got[k].score == pytest.approx(1 / (1 + np.exp(-z)))


def plain_statistics(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many = Counter(wins)
    covered = {k + j for k, w in enumerate(wins) if many[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + ODD
    got = weak_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_statistics(r.carried.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    names = list(weak_rules.rules())
    votes = Counter(tuple(r[f"v_{k}"] for k in names) for r in got)
    share, rates = weak_rules.estimate(sorted(votes.items()), len(names))
    for r in got:
        p = weak_rules.posterior(tuple(r[f"v_{k}"] for k in names), share, rates)
        assert r.posterior == pytest.approx(p) and r.kept == (not r.base_failed and p >= 0.5)
    assert weak_rules.judge(odd(spark).limit(0), ["doc_id"]).count() == 0


def plain_signatures(text):
    """Signatures by whole numbers, a spot at a time."""
    import xxhash

    mask, (m0, m1, m2, m3) = 2**64 - 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
    common, numbers = set(spotsigs.COMMON.split()), []
    for word in text.lower().split():
        core = word.strip(spotsigs._EDGE) or word
        numbers.append((xxhash.xxh64_intdigest(core) & ~1 | (core in common), core in common))
    if not numbers:
        return []
    if all(c for _, c in numbers):
        return [xxhash.xxh32_intdigest(b"".join(h.to_bytes(8, "little") for h, _ in numbers))]
    spots, out = [(m0, 0), *((h, k + 1) for k, (h, c) in enumerate(numbers) if c)], set()
    for h, at in spots:
        chain = [x for x, c in numbers[at:] if not c][: spotsigs.CHAIN]
        if chain:
            mixed = h * m0 & mask
            for x in (*chain, *[0] * (spotsigs.CHAIN - len(chain))):
                mixed = ((mixed ^ mixed >> 29) * m1 + x * m2) & mask
            out.add((mixed ^ mixed >> 32) * m3 % 2**64 >> 32)
    return sorted(out)


def test_rules_estimate_by_brute_force():
    """Expectation-maximisation over patterns equals the same over single documents, step by step."""
    rng = np.random.default_rng(6)
    good = rng.random(400) < 0.7
    votes = np.where(rng.random((400, 3)) < 0.8, np.where(good, 1, -1)[:, None] * np.where(rng.random((400, 3)) < [0.95, 0.8, 0.6], 1, -1), 0)
    share, rates = weak_rules.SHARE, np.array([weak_rules.PRIOR] * 3)  # rule, kind, vote
    for _ in range(weak_rules.ROUNDS):
        a, b = (np.prod(rates[np.arange(3), kind, votes + 1], 1) for kind in (0, 1))
        p = share * a / (share * a + (1 - share) * b)
        share = (p.sum() + weak_rules.DOCUMENTS * weak_rules.SHARE) / (400 + weak_rules.DOCUMENTS)
        for kind, w in ((0, p), (1, 1 - p)):
            for v in (-1, 0, 1):
                rates[:, kind, v + 1] = (((votes == v) * w[:, None]).sum(0) + weak_rules.VOTES * weak_rules.PRIOR[kind][v + 1]) / (w.sum() + weak_rules.VOTES)
    got = weak_rules.estimate(sorted(Counter(map(tuple, votes.tolist())).items()), 3)
    assert got[0] == pytest.approx(share, abs=1e-4) and np.allclose(got[1], rates, atol=1e-4)
    assert weak_rules.estimate([], 3) == (weak_rules.SHARE, [weak_rules.PRIOR] * 3)


def test_rules_that_always_agree_say_nothing():
    rng = np.random.default_rng(8)
    good = rng.random(3000) < 0.9
    told = [np.where(rng.random(3000) < 0.95, np.where(good, 1, -1), np.where(good, -1, 1)) for _ in range(3)]
    votes = np.stack([*told, np.ones(3000, int), np.ones(3000, int), np.ones(3000, int)], 1)
    share, rates = weak_rules.estimate(sorted(Counter(map(tuple, votes.tolist())).items()), 6)
    assert abs(share - good.mean()) < 0.02
    p = np.array([weak_rules.posterior(tuple(v), share, rates) for v in votes.tolist()])
    assert ((p >= 0.5) == good).mean() > 0.98


def test_rules_decide(spark):
    """On labelled documents, none of which the method sees, the posterior tells more than the base rules, and no rate is at 0 or 1."""
    sf = "/root/testdata/sf0.1"
    judged = weak_rules.judge(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"]).select("carried.doc_id", "base_failed", "posterior", "kept", *[f"v_{k}" for k in weak_rules.rules()]).collect()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    told = [(r, quality[r.doc_id]) for r in judged if quality.get(r.doc_id) is not None]
    passed = [(r, q) for r, q in told if not r.base_failed]
    low = [r for r, q in passed if q == 0]
    assert len(low) > 100 and sum(not r.kept for r in low) >= 0.9 * len(low)
    assert sum(r.kept for r, q in passed if q == 1) >= 0.98 * sum(q for _, q in passed)
    right = lambda f: sum(f(r) == q for r, q in told) / len(told)
    assert right(lambda r: r.kept) > right(lambda r: not r.base_failed) + 0.05
    votes = Counter(tuple(r[f"v_{k}"] for k in weak_rules.rules()) for r in judged)
    share, rates = weak_rules.estimate(sorted(votes.items()), len(weak_rules.rules()))
    assert 0.5 < share < 0.98 and all(0 < x < 1 for r in rates for kind in r for x in kind)


def test_spotsigs_likeness():
    rng = np.random.default_rng(3)
    for least in (0.05, 0.5, 0.8):
        for _ in range(300):
            a, b = (np.unique(rng.integers(0, 900, rng.integers(0, 700))).astype(np.uint32) for _ in range(2))
            if rng.random() < 0.5:
                b = np.unique(np.concatenate([a[rng.random(a.size) < 0.9], b[:20]]))
            exact = len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b))) if a.size and b.size else float(a.size == b.size)
            assert spotsigs.likeness(a, b, least) == (exact if exact >= least else 0.0)
            if exact >= least and a.size and b.size:
                assert abs(spotsigs.partition(a.size, least) - spotsigs.partition(b.size, least)) <= 1


def test_spotsigs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(-5, None), (-6, "the of"), (None, "last one")]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1] or ""
        text = text or ""
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        sets = [plain_signatures(t) for t in (text, changed, following)]
        like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else float(not a and not b)
        near = [like(sets[0], sets[1]), like(sets[0], sets[2])]
        want[i] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), *("".join(f"{x:08x}" for x in s) for s in sets[:2]), *near)
    got = {r.id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.alike_edited, r.alike_next) for r in spotsigs.against_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4] and got[i][4:6] == pytest.approx(w[4:]) and got[i][6:] == tuple(x >= 0.8 for x in w[4:])
    assert any(0 < x < 0.05 for w in want.values() for x in w[4:])  # small likenesses, too, are exact
    assert spotsigs.against_next(odd(spark).limit(1)).count() == 1


def test_spotsigs_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    members, pairs = spotsigs.similar_pairs(docs)
    sets = {r.doc_id: spotsigs.Spotter().signatures(r.text) for r in docs.collect()}
    named = {r["id"]: r["class"] for r in members.collect()}
    heads = sorted(set(named.values()))
    want = {(a, b) for k, a in enumerate(heads) for b in heads[k + 1 :] if spotsigs.likeness(sets[a], sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want


def test_spotsigs_pairs_of_shared_ids(spark):
    base = [[f"word{k}x{j} the" for j in range(30)] for k in range(3)]
    # Two near sets of null ids, two of one id, two of different ids with a null copy.
    ids = [(None, None), (7, 7), (9, 8)]
    rows = [(i, " ".join(b if k == 0 else [*b, "tail"])) for b, pair in zip(base, ids, strict=True) for k, i in enumerate(pair)]
    members, pairs = spotsigs.similar_pairs(spark.createDataFrame([*rows, (None, rows[5][1])], "doc_id long, text string"))
    assert sorted(((r.a, r.b) for r in pairs.collect()), key=str) == sorted([(None, None), (7, 7), (8, 9)], key=str)
    assert members.count() == 7 and members.select("key").distinct().count() == 6


def removed(rows, length=20):
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - length + 1):
            if seen.setdefault(tuple(words[k : k + length]), (i, k)) != (i, k):
                gone |= set(range(k, k + length))
        out[i] = (len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode())
    return out


def test_substrings(spark, monkeypatch):
    import random

    rng = random.Random(2)
    base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(400)]
    rows = [(1, None), (2, "x " * 70), (3, "x y " * 50), (None, "x y z " * 30)]
    for k in range(4, 60):
        s = rng.randrange(350)
        rows.append((k, " ".join(rng.choice("pqrs") for _ in range(rng.randint(0, 9))) + " " + " ".join(base[s : s + rng.randint(10, 60)]) + "\n tail"))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # Each switch on both sides: anchors dealt by windows, tasks that hold little, shards of an anchor each.
    for many, held, windows, shard in ((substring_fm.MANY, substring_fm.HELD, substring_fm.HELD_WINDOWS, substring_fm.SHARD_WORDS), (1, 40, 50, 1), (0, 1, 1, 300)):
        for name, value in (("MANY", many), ("HELD", held), ("HELD_WINDOWS", windows), ("SHARD_WORDS", shard)):
            monkeypatch.setattr(substring_fm, name, value)
        got = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_fm.dedupe(frame).collect()}
        assert got == removed(rows)
    monkeypatch.undo()
    # The common runs of words only say what meets where.
    monkeypatch.setattr(substring_fm, "common_grams", lambda docs, length, gram: np.zeros(0, np.uint64))
    assert {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_fm.dedupe(frame).collect()} == removed(rows)
    monkeypatch.undo()
    twice = spark.createDataFrame([(1, "w " * 30), (1, "w " * 30), (2, "v " * 30)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_fm.dedupe(twice).collect()) == [29, 29, 29]
    assert substring_fm.dedupe(odd(spark).limit(0)).count() == 0


def test_substrings_of_shared_ids_and_clashing_columns(spark):
    x = " ".join(f"x{k}" for k in range(25))
    rows = [(3, x), (3, "other " + x), (None, x + " end"), (None, "short"), (1, "y " * 25), (9, None)]
    frame = spark.createDataFrame([(*r, 7, "k", 1, 2, 3, "z") for r in rows], "doc_id long, text string, id long, kept string, n_words long, n_removed long, doc long, carried string").repartition(3)
    got = substring_fm.dedupe(frame, carry=[c for c in frame.columns if c not in ("doc_id", "text")]).collect()
    assert len(got) == len(rows) and all(tuple(r.carried) == (7, "k", 1, 2, 3, "z") for r in got)
    # Two texts of id 3 have the passage: one of them keeps it; so all 25 words go twice, and y's but the first window's 20.
    assert sum(r.n_removed for r in got) == 25 + 25 + 24
    assert {tuple((i.first, i.words) for i in r.intervals) for r in got if r.id is None} == {((0, 25),), ()}


def test_fm_index():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 7, 3000), 0)  # the text ends in a number that it has once
    index = substring_fm.FmIndex(text, 7, 3000)
    for _ in range(50):
        p = rng.integers(1, 7, 4)
        low, high = np.array([0]), np.array([text.size])
        for c in p[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        want = [k for k in range(text.size - 3) if (text[k : k + 4] == p).all()]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_matching_statistics():
    rng = np.random.default_rng(5)
    text = np.append(rng.integers(1, 4, 400), 0)
    index = substring_fm.FmIndex(text, 4, 400)
    ends = np.arange(30, 390, 9)
    got, low, high = index.matches(text, ends, np.full(ends.size, 25), 4)
    for e, m, a, b in zip(ends.tolist(), got.tolist(), low.tolist(), high.tolist(), strict=True):
        times = lambda n: sum((text[k : k + n] == text[e - n + 1 : e + 1]).all() for k in range(text.size - n + 1))  # noqa: E731, B023
        assert m == max([n for n in range(1, 26) if times(n) > 1], default=0)
        assert m < 4 or b - a == times(4)


def test_common_runs_of_words_come_last(spark):
    line = " ".join(f"c{k}" for k in range(30))
    docs = spark.createDataFrame([(k, f"{k}a {k}b {k}c {line} {k}d {k}e") for k in range(20)], "doc_id long, text string")
    common = substring_fm.common_grams(docs, id_col="doc_id")
    assert common.size == 24 and (np.sort(common) == common).all()
    texts = [r.text.encode() for r in docs.collect()]
    anchors = [set(substring_fm.Segmenter(common=common).segments([t])[0].tolist()) for t in texts]
    # What documents share but for windows within the line: nothing, as other windows have a run of their own.
    inside = set(substring_fm.Segmenter(common=common).segments([line.encode()])[0].tolist())
    assert anchors[0] & anchors[1] == inside and substring_fm.common_grams(docs.limit(0), id_col="doc_id").size == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * len(rows)
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "substrings", "mixture", "tokens"]
