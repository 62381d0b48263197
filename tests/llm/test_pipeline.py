"""The pipeline's stages against brute force, each on what the one before it kept, with odd rows and columns that clash."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from foliospark.llm import langid, mixing, substring_fm

from .test_simhash import wide_classes

WORDS = {"en": "the of and to in was that it with from this have house water light green stone river", "de": "der die und das von zu mit ist nicht ein auch haus wasser licht stein fluss wald", "fr": "le la les des un une et est que pour dans maison eau pierre lumiere fleuve foret"}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _first long, id string, kept string, n_words int, n_removed int, tie string, times int, carried string, place string, hash string, doc long"


def rows():
    rng = random.Random(11)
    say = lambda lang, n: " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", "a", "en", "st"]) for _ in range(n))
    passage = say("en", 30)
    out = []
    for k in range(60):
        lang = rng.choice(list(WORDS))
        text = say(lang, rng.randint(25, 90))
        out.append((k, text if k % 6 else f"{text} {passage} {say(lang, 9)}", lang, "abc"[k % 3] if k % 7 else None))
    out += [(100 + k, out[k][1], out[k][2], "b") for k in range(8)]  # copies
    out += [(200, None, "en", "a"), (201, "", None, "a"), (202, " \n\t", "en", "b"), (203, "123 456 !!", None, "c"), (None, say("de", 40), "de", "a"), (None, say("fr", 40), None, None)]
    out += [(300, say("en", 30), "en", "a"), (300, say("de", 30), "de", "b"), out[5], (301, (say("fr", 50) + "\n") * 60, "fr", "c")]
    return [(i, t, lang, s, len(t or ""), 0.5, "x", 7, "y", "z", 1, 2, "t", 3, "c", "p", "h", 9) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3)


def held(df):
    return Counter(tuple(r) for r in df.collect())


def stage(spark, name, df):
    out = dict(corpus_pipeline.STAGES)[name](spark, df, "")
    return spark.createDataFrame(out.collect(), out.schema)


@pytest.fixture(scope="module")
def kept(spark, docs):
    out = {"": docs}
    before = docs
    for name, _ in corpus_pipeline.STAGES:
        out[name] = before = stage(spark, name, before)
    return out


def test_language(kept, docs):
    model = langid.fit(langid.training_rows(docs, docs.doc_id.isNull() | docs.doc_id.isNotNull()))
    parser, want = langid.Parser(model), Counter()
    for r in rows():
        (lang,), (score,) = parser.predict([r[1]])
        if lang != "und" and score >= corpus_pipeline.LEAST_SCORE:
            want[(*r[:2], lang, *r[3:])] += 1
    assert held(kept["language"]) == want and kept["language"].columns == docs.columns
    assert sum(want.values()) == len(rows()) - 4  # all but those without a letter


def test_near_duplicates(kept):
    before = list(kept["language"].collect())
    root = wide_classes([(k, r.text) for k, r in enumerate(before)])
    groups = {}
    for k, r in enumerate(before):
        groups.setdefault(root[k], []).append(r)
    left = list(kept["near_duplicates"].collect())
    assert len(left) == len(groups)
    for group in groups.values():
        own = [r for r in left if r in group]
        assert len(own) == 1 and own[0].doc_id == min((r.doc_id for r in group if r.doc_id is not None), default=None)


def test_substrings(kept):
    before = list(kept["near_duplicates"].collect())
    seen, told = {}, {}
    # Null ids come last, equal ids in order of the text's hash: of equal ids any order tells as many windows.
    order = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    for at, r in enumerate(order):
        words, gone = (r.text or "").split(), set()
        for k in range(len(words) - substring_fm.LENGTH + 1):
            if seen.setdefault(tuple(words[k : k + substring_fm.LENGTH]), (at, k)) != (at, k):
                gone |= set(range(k, k + substring_fm.LENGTH))
        told[at] = r.text if not gone else " ".join(w for k, w in enumerate(words) if k not in gone)
    want = Counter((r.doc_id, told[at], r.lang, r.source, len(told[at])) for at, r in enumerate(order) if told[at])
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in kept["substrings"].collect()) == want
    assert any(len(t) < len(r.text) for t, r in zip(told.values(), order, strict=True))
    assert {tuple(r)[5:] for r in kept["substrings"].collect()} == {rows()[0][5:]}


def test_mixture(kept):
    before = list(kept["substrings"].collect())
    size = lambda r: len(r.text.split())
    sources = sorted({r.source for r in before}, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    of = {s: sum(size(r) for r in before if r.source == s) for s in sources}
    total, full = sum(of.values()), set()
    while True:
        rest = [s for s in sources if s not in full]
        level = (total - sum(3 * of[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        more = {s for s in rest if 3 * of[s] <= level * weight[s]}
        if not more:
            break
        full |= more
    target = {s: 3.0 * of[s] if s in full else level * weight[s] for s in sources}
    want = Counter()
    for s in sources:
        whole, run = int(target[s] // of[s]), 0
        owed = target[s] - whole * of[s]
        for r in sorted((r for r in before if r.source == s), key=lambda r: hashlib.md5(f"{mixing.SEED}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()):
            run += size(r)
            more = run <= owed or (run - size(r) < owed and run - owed < owed - (run - size(r)))
            want[tuple(r)] += whole + more
    assert held(kept["mixture"]) == Counter({k: v for k, v in want.items() if v})


def test_mixture_of_equal_rows(spark):
    """Rows alike in all columns are taken as often as mix() takes each of them, together."""
    rows_ = [(1, "one two three", "a")] * 4 + [(2, "four five", "a"), (3, "six " * 40, "b")]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mix(df, carry=df.columns).collect():
        want[tuple(r.carried)] += r.times
    assert held(corpus_pipeline.mixture(spark, df, "")) == Counter({k: v for k, v in want.items() if v})


def test_tokens(kept):
    import public_tokenizers

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for r in kept["mixture"].collect():
        ids = lib.encode(r.text, add_bos=True, add_eos=True)
        want[r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert held(kept["tokens"]) == want and want


def test_run_is_its_stages(spark, kept, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert held(got) == held(kept["tokens"])


def test_no_documents(spark, tmp_path):
    none = spark.createDataFrame([], COLUMNS)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, "").count() == 0, name
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
