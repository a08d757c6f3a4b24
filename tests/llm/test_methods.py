"""The methods against brute force: what the contracts alone don't show."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafwright.llm import bpe, dac, language_id, licenses, mixing, near_dups, pii, quality, queries, token_counts, vectors
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in queries.documents(spark, SF).select("doc_id", "text").collect()}


@pytest.mark.parametrize("block", [7, 64, 65536])
def test_token_counts_across_blocks(spark, texts, block):
    tok = Tokenizer.from_file(queries.BYTE_BPE)
    docs = queries.documents(spark, SF).unionByName(spark.createDataFrame([(-1, None, None, None, None), (-1, "", None, None, None), (None, "a null id", None, None, None)], queries.documents(spark, SF).schema))
    path = token_counts.write_flat(docs.repartition(3), queries.BYTE_BPE, end_id=50256, block_ids=block)
    found = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.scan(spark, path, end_id=50256).collect())
    want = Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in texts.items())
    assert found == want + Counter([(-1, 0), (-1, 0), (None, len(tok.encode("a null id").ids))])


def test_random_access_to_ids(spark):
    path = dac.write(queries.documents(spark, SF), queries.WORD_BPE)
    rng = np.random.default_rng(3)
    for r in dac.segments(spark, path).select("payload").collect():
        segment = dac.Segment(bytes(r["payload"]))
        ids = segment.ids()
        for i in [0, len(ids) - 1, *rng.integers(0, len(ids), 500).tolist()]:
            assert segment.access(i) == ids[i]
        with pytest.raises(IndexError):
            segment.access(len(ids))
    wide = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1] * 200, np.uint32)
    segment = dac.Segment(dac.pack(wide, np.array([1]), np.array([False]), np.array([0, len(wide)])))
    assert [segment.access(i) for i in range(len(wide))] == wide.tolist()


def test_mix_is_the_draw(spark):
    """Shards, permutations and the join of blocks restated from the plan's sizes."""
    plan = mixing.Mix(queries.documents(spark, SF), block_words=16)
    slots = plan.slots().collect()
    total, n_shards = sum(plan.quota), -(-sum(plan.quota) // mixing.SHARD_SLOTS)
    assert len(slots) == total and len({(r["shard"], r["slot"]) for r in slots}) == total
    assert Counter(r["src"] for r in slots) == {i: q for i, q in enumerate(plan.quota) if q}
    drawn = defaultdict(Counter)
    share = np.array(plan.quota) / total
    for shard in range(n_shards):
        n = min(mixing.SHARD_SLOTS, total - shard * mixing.SHARD_SLOTS)
        drawn[shard] = np.random.Generator(np.random.Philox(key=[plan.seed, shard])).multinomial(n, share)
    # only what a source was drawn beyond its quota may go to others
    over = np.maximum(sum(drawn.values()) - np.array(plan.quota), 0).sum()
    moved = sum(max(drawn[s][i] - n, 0) for s in drawn for i, n in enumerate(np.bincount([r["src"] for r in slots if r["shard"] == s], minlength=len(share))))
    assert moved == over
    for src, turn in {(r["src"], r["pass"]) for r in slots}:
        taken = [r["block"] for r in slots if (r["src"], r["pass"]) == (src, turn)]
        assert len(set(taken)) == len(taken) and max(taken) < plan.n_blocks[src]
    times = Counter((r["src"], r["block"]) for r in slots)
    place = {(r["src"], r["doc_id"], r["at"]): r["size"] for r in plan.placed().collect()}
    want = Counter()
    for (src, doc, at), size in place.items():
        want[doc] += sum(times[src, w // 16] for w in range(at, at + size))
    assert want == Counter({r["doc_id"]: r["taken"] for r in plan.taken().collect() if True}) + Counter()
    for src in {s for s, _, _ in place}:
        spans = sorted((at, at + n) for (s, _, at), n in place.items() if s == src and n)
        assert [a for a, _ in spans] == [0, *(z for _, z in spans[:-1])] and spans[-1][1] == plan.sizes[src]


def test_permutations_are_bijections():
    for n in (1, 2, 3, 5, 64, 1000):
        i = np.arange(n)
        assert sorted(mixing.permuted(i, np.full(n, n), np.full(n, 12345, np.uint64))) == list(range(n))


def test_license_blocks(spark):
    rng = np.random.default_rng(5)
    pool = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()}) + [f"x{k}" for k in range(40)]
    rows = []
    for k in range(60):
        words = [pool[j] for j in rng.integers(0, len(pool), 150)]
        for label in rng.choice(sorted(licenses.TEMPLATES), 2):
            t = licenses.TEMPLATES[label].split()
            at = int(rng.integers(0, 100))
            words[at : at + len(t)] = [w if rng.random() > 0.12 else "zz" for w in t]
        rows.append((k, " ".join(words)))
    want = {}
    for k, text in rows:
        words, best = text.split(), {}
        for block in range(0, len(words), licenses.STEP):
            held = set(words[block : block + 2 * licenses.STEP])
            for label, t in licenses.TEMPLATES.items():
                share = len(held & set(t.split())) / len(set(t.split()))
                if share >= licenses.THRESHOLD - 1e-9:
                    best[label] = max(best.get(label, 0), share)
        want[k] = best
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert any(want.values())
    for k, best in want.items():
        base = set(filter(None, found[k]["base_labels"].split(",")))
        assert set(filter(None, found[k]["labels"].split(","))) == base | set(best)
        assert found[k]["score"] == pytest.approx(1.0 if base else max(best.values(), default=0.0))


def test_planted_vectors(spark):
    rng = np.random.default_rng(9)
    rows, n, dim = [], 0, 32
    for k in range(400):
        v = rng.standard_normal(dim)
        v /= np.linalg.norm(v)
        side = rng.standard_normal(dim)
        side -= (side @ v) * v
        side /= np.linalg.norm(side)
        for c in (1.0, rng.uniform(0.931, 0.95), rng.uniform(0.90, 0.928)):
            rows.append((n, (c * v + (1 - c * c) ** 0.5 * side).tolist(), k % 3))
            n += 1
    rows += [(n + k, rows[0][1], 0) for k in range(700)]  # a hot cell of equal vectors
    want = brute.vector_links(rows[:1200])
    found = {r["vec_id"]: r for r in vectors.near_dups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    alone = [i for i in range(1200) if i % 3 == 1 and i > 2]
    links = sum(len(want[i]) for i in range(3, 1200))
    got = sum(found[i]["n_links"] for i in range(3, 1200))
    assert links >= 700 and 0.9 * links <= got <= links
    assert all(found[i]["n_links"] <= len(want[i]) for i in alone)
    assert found[0]["n_links"] >= 700 and all(found[1200 + k]["component_id"] == 0 for k in range(700))


def test_posteriors_of_quality():
    """EM restated with one loop a pattern, on votes drawn from known rules."""
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.8
    right = [0.9, 0.8, 0.7]
    votes = [tuple(int(v) for v in np.where(rng.random(3) < 0.2, 0, np.where(rng.random(3) < right, 1, -1) * (1 if t else -1))) for t in truth]
    counted = Counter(votes)
    found, _ = quality.fit(counted, 3)
    total, prior = sum(counted.values()), 0.005
    every = list(itertools.product((-1, 0, 1), repeat=3))
    good = {p: 0.1 if -1 in p else 0.95 for p in every}
    for _ in range(50):
        held = {c: {p: counted[p] * (good[p] if c else 1 - good[p]) for p in every} for c in (0, 1)}
        share = (sum(held[1].values()) + prior * total) / (total * (1 + 2 * prior))
        prob = {}
        for r, c in itertools.product(range(3), (0, 1)):
            seen = [sum(w for p, w in held[c].items() if p[r] == v) + prior * sum(held[c].values()) + 1e-3 for v in (-1, 0, 1)]
            prob[r, c] = [x / sum(seen) for x in seen]
        for p in every:
            a, b = ((share if c else 1 - share) * np.prod([prob[r, c][p[r] + 1] for r in range(3)]) for c in (1, 0))
            good[p] = a / (a + b)
    assert all(found[p] == pytest.approx(good[p], abs=1e-9) for p in every)
    assert np.mean([(found[v] >= 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.85


def test_quality_verdicts_are_posteriors(spark):
    judged = quality.judge(queries.documents(spark, SF)).collect()
    names = [f"vote_{k}" for k in quality.votes()]
    posterior, _ = quality.fit(Counter(tuple(r[n] for n in names) for r in judged), len(names))
    for r in judged:
        assert r["posterior"] == pytest.approx(posterior[tuple(r[n] for n in names)])
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_posteriors_of_personal_data():
    """EM and the classifier restated with plain loops, on votes drawn from known labelers."""
    rng = np.random.default_rng(6)
    counted, truth = Counter(), defaultdict(Counter)
    for _ in range(3000):
        t = rng.random() < 0.6
        v = tuple(int(x) for x in np.where(rng.random(4) < 0.25, 0, np.where(rng.random(4) < [0.9, 0.8, 0.75, 0.7], 1, -1) * (1 if t else -1)))
        p = (str(rng.choice(["name", "secret"])), v, (int(rng.integers(0, 2) + t), 0, 1, 0, 0, 1, 2))
        counted[p] += 1
        truth[p][t] += 1
    found = pii.fit(counted, rounds=5)
    post = {p: 1 / (1 + np.exp(-2.0 * sum(p[1]))) for p in counted}
    for _ in range(5):
        logit = {}
        held = [{p: n * (1 - post[p]) for p, n in counted.items()}, {p: n * post[p] for p, n in counted.items()}]
        for p in counted:
            score = []
            for c in (0, 1):
                s = np.log(sum(held[c].values()) + 1.0)
                for k in range(4):
                    seen = [sum(w for q, w in held[c].items() if q[1][k] == x) + prior for x, prior in zip((-1, 0, 1), ((3, 2, 1), (1, 2, 3))[c], strict=True)]
                    s += np.log(seen[p[1][k] + 1] / sum(seen))
                score.append(s)
            logit[p] = score[1] - score[0]
        post = {p: 1 / (1 + np.exp(-x)) for p, x in logit.items()}
    # the classifier: the weighted loss has its least value where the gradient vanishes, with the same small penalty
    names = sorted({("kind", p[0]) for p in counted} | {(k, v) for p in counted for k, v in enumerate(p[1]) if v} | {("level", k, x) for p in counted for k, x in enumerate(p[2])}, key=str)
    rows = sorted(counted)
    x = np.array([[1.0, *(n == ("kind", p[0]) or (n[0] != "kind" and n[0] != "level" and p[1][n[0]] == n[1]) or (n[0] == "level" and p[2][n[1]] == n[2]) for n in names)] for p in rows], float)
    n, y, w = np.array([counted[p] for p in rows], float), np.array([post[p] for p in rows]), np.zeros(1 + len(names))
    for _ in range(2000):
        w -= 0.3 * (x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) / n.sum() + 1e-4 * w)
    want = 1 / (1 + np.exp(-x @ w))
    assert [found[p] for p in rows] == pytest.approx(list(want), abs=1e-6)
    right = sum(c[found[p] >= 0.5] for p, c in truth.items())
    assert right > 0.85 * sum(counted.values())


def test_languages_of_other_alphabets(spark):
    words = {"el": "και το της που με για από στην ότι είναι θα δεν μια", "ru": "и в не на что он как это по но из за все", "ar": "من في على أن إلى هذا التي كان مع عن ما هو", "zh": "的 一 是 在 不 了 有 和 人 这 中 大 为 上", "en": "the of and to in that is was for on with as", "bg": "и на да се от за не по като ще са това един"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(w.split(), 30)), lang) for i, (lang, w) in enumerate(itertools.islice(itertools.cycle(words.items()), 900))]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    told = {i: lang for i, _, lang in rows}
    assert len(found) > 100 and np.mean([r["lang_pred"] == told[r["doc_id"]] for r in found]) > 0.98


def test_profiles_by_hand():
    twice, once, plain = language_id._letters()
    a, b, c = 1, 2, 3
    gram = np.array([(a << 14) + (b << 7) + c])
    assert (language_id.gram_vectors(gram)[0] == twice[a] * once[b] * plain[c]).all()


def test_boilerplate_keeps_its_links(spark):
    """Pairs just above the similarity in a crowd that shares most bands."""
    common = [f"c{k}" for k in range(70)]
    docs, n = [], 0
    for k in range(1200):
        own = [f"d{k}_{j}" for j in range(60)]
        docs.append((n, " ".join(common + own)))
        n += 1
        if k < 400:
            near = common + own
            near[95], near[110] = f"e{k}", f"f{k}"
            docs.append((n, " ".join(near)))
            n += 1
    found = {r["doc_id"]: r["class_id"] for r in near_dups.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    pairs = [(2 * k, 2 * k + 1) for k in range(400)]
    a, b = (set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for _, t in docs[:2])
    assert 0.8 <= len(a & b) / len(a | b) < 0.86
    assert sum(found[i] == found[j] for i, j in pairs) >= 0.99 * len(pairs)
    assert len({found[i] for i, _ in docs}) >= 1200  # and nothing else


def test_rows_without_ids_and_ids_of_several_texts(spark):
    one, two = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(50))
    docs = [(None, one), (None, one), (5, one), (5, two), (7, two), (9, None), (None, None), (9, "")]
    found = near_dups.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"] or 0, r["class_size"], r["kept"]) for r in found)
    # two texts under one id are two classes, both named 5
    assert got == [(False, 5, 5, 2, True), (False, 5, 5, 3, True), (False, 7, 5, 2, False), (False, 9, 9, 1, True), (False, 9, 9, 1, True), (True, 0, 0, 1, True), (True, 0, 5, 3, False), (True, 0, 5, 3, False)]


def test_spans_have_no_longest(spark):
    for text, kind in [("x" * 300 + " [at] " + "y" * 200 + " [dot] " + "com", "spelled_email"), ("Mrs " + "A" + "b" * 80, "name"), ("password=" + "aB3" * 4000, "secret")]:
        found = [p for p in pii.proposals(text, []) if p[0] == kind]
        assert [(p[1], p[2]) for p in found] == [(0, len(text))]
    for run in ("a." * 100000, "Mr A" + "b" * 200000 + "_", "x [at] " * 30000):
        pii.proposals(run + " [at] 0000", [])


def test_decoding_gives_texts_back(spark, texts):
    docs = queries.documents(spark, SF)
    back = bpe.decode(bpe.encode(docs, queries.BYTE_BPE), queries.BYTE_BPE)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in texts.items()}


def test_clashing_columns_through_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    names = ("lang_pred", "score", "_text", "times", "row", "key", "found", "digest", "_picks", "a.b")
    docs = queries.documents(spark, SF)
    odd = docs.withColumns({c: F.lit(c) for c in names})
    odd = odd.unionByName(odd.where("doc_id < 20")).unionByName(odd.where("doc_id < 9").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = queries_cut(stage(spark, odd, SF), tmp_path / name)
        assert odd.columns == [*docs.columns, *names], name
        assert odd.where("`a.b` = 'a.b' and score = 'score'").count() == odd.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()


def queries_cut(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))
