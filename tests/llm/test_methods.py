"""Each method against a plain version of itself, where the contracts alone would not show it."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lectern.llm import ann, ftrl, packing, secrets, toxicity
from lectern.llm import queries as Q
from lectern.llm.text import chunks

PIECES = [*"abZéÉßİΣσς'~.,!19²Ⅳ»…_$-ΩжЖẞñÀ×÷ÿŸ", "'s", "'T", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", " ", "\n", "\t", "́", "日本", "ﬁ", " ", "the", "ö###", "\x1c", "😀", "x" * 70]


def test_ids_equal_the_tokenizers_own():
    from tokenizers import Tokenizer

    path, rng, known = Q.word_tokenizer(), random.Random(3), {}
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(20_000)] + [None, ""]
    for i, j, buf, off in chunks(pa.array(texts)):
        ids, bounds = packing.encode(buf, off, definition, known)
        for text, a, b in zip(texts[i:j], bounds[:-1], bounds[1:]):
            assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_packing_is_best_fit_decreasing():
    rng, room = random.Random(1), 64
    lengths = [rng.randrange(1, 150) for _ in range(400)]
    open_, want = [], []
    rests = sorted(((d, n // room * room, n % room) for d, n in enumerate(lengths) if n % room), key=lambda x: (-x[2], x[0]))
    for piece in rests:
        fits = [w for w, left in enumerate(open_) if left >= piece[2]]
        if fits:
            tightest = min(open_[w] for w in fits)
            assert packing_room(open_, fits, tightest)
            w = next(w for w in fits if open_[w] == tightest)
        else:
            open_.append(room)
            want.append([])
            w = len(open_) - 1
        open_[w] -= piece[2]
        want[w].append(piece)
    got = packing.plan(lengths, room, slack=room)
    full = sum(n // room for n in lengths)
    assert got[:full] == [[(d, s, room)] for d, n in enumerate(lengths) for s in range(0, n // room * room, room)]
    assert sorted(sum(n for _, _, n in w) for w in got[full:]) == sorted(sum(n for _, _, n in w) for w in want)


def packing_room(open_, fits, tightest):
    return all(open_[w] >= tightest for w in fits)


def test_streamed_windows_stay_few():
    rng = random.Random(2)
    lengths = [max(1, int(rng.paretovariate(1.1) * 60)) for _ in range(3000)]
    windows = packing.plan(lengths)
    assert sum(n for w in windows for _, _, n in w) == sum(lengths)
    streamed = sum(s % packing.WINDOW > 0 for w in windows for _, s, _ in w)
    assert streamed <= 0.15 * len(windows)


def test_neighbours_of_repeated_queries_and_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 32))
    x = (centres[np.arange(3000) % 150] + 0.1 * rng.normal(size=(3000, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows + rows[:51], "vec_id long, embedding array<float>")
    found = ann.search(vectors, vectors.where("vec_id % 50 = 0")).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == set(range(0, 3000, 50)) and all(sorted(k for k, _ in v) == [1, 2, 3, 4, 5] for v in got.values())
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    copies = np.concatenate([np.arange(3000), np.arange(51)])
    hits = 0
    for q, v in got.items():
        score = (unit @ unit[q])[copies]
        score[copies == q] = -2
        hits += len({i for _, i in v} & set(copies[np.argsort(-score, kind="stable")[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(got)
    turn, radius, width = ann.fit(unit, len(unit))
    index = ann.Index(ann.encode(unit, turn), width)
    touched = [len(index.probe(index.codes[q], radius)) / len(unit) for q in range(0, 3000, 50)]
    assert np.mean(touched) < 0.25  # isotropic vectors have no such luck; the README gives the share there
    for q in range(0, 3000, 500):
        near = np.flatnonzero(ann.distances(index.codes, index.codes[q]) <= radius)
        assert index.within(index.codes[q], radius).tolist() == near.tolist()


def test_the_secret_model_tells_strings_that_no_pattern_names(spark):
    rng, rows, planted = random.Random(9), [], 0
    letters = "abcdefghijklmnopqrstuvwxyz"
    for i in range(200):
        word = "".join(rng.choice(letters if i % 2 else letters.upper() + letters + "0123456789") for _ in range(32))
        rows.append((i, f"the value {word} was printed"))
    plain = ["getUserAccountNameFromDatabase", "default-notification-settings", "/usr/local/share/applications/index", "Geschwindigkeitsbegrenzung", "anticonstitutionnellement", "MAXIMUM_CONNECTION_POOL_SIZE", "internationalization_of_messages"]
    rows += [(1000 + i, f"see {w} for more") for i, w in enumerate(plain)]
    rows.append((2000, "deadbeefdeadbeef-qzXk93LmPw7TtRv2YbNc5sHd8Fg"))
    model = secrets.train(secrets.labelled_samples(spark))
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    planted = sum(any(f["kind"] == "markov" and (f["start"], f["stop"]) == (10, 42) for f in got[i]["found"]) for i in range(200))
    assert planted >= 190
    assert sum(bool(got[1000 + i]["found"]) for i in range(len(plain))) == 0
    assert [(f["kind"], f["start"], f["stop"]) for f in got[2000]["found"]] == [("hex", 0, 16), ("markov", 16, 44)]


def test_an_untrained_chain_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    marked, categories = toxicity.label_categories(labels)
    assert toxicity.without_toxic(docs, toxicity.train(docs, marked, categories), categories).count() == 3


def test_ftrl_follows_its_update_rule():
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6)) for _ in range(60)]
    y, alpha, beta, l1, l2 = rng.integers(0, 2, 60), 0.3, 1.0, 0.05, 0.1
    z, n = [0.0] * 40, [0.0] * 40

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (1 if z[i] > 0 else -1) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for r in order.permutation(60):
            at, x = rows[r]
            w = [weight(i) for i in at]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x))))
            for i, v, own in zip(at, x, w):
                g = (p - y[r]) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * own
                n[i] += g * g
    assert ftrl.fit(rows, y, 40, alpha=alpha, beta=beta, l1=l1, l2=l2) == pytest.approx([weight(i) for i in range(40)], abs=1e-9)


def test_chain_learns_from_out_of_fold_probabilities():
    rng = np.random.default_rng(6)
    raw = [(np.sort(rng.choice(300, 8, replace=False)), np.ones(8)) for _ in range(90)]
    marks = np.stack([[float(at.min() < 20) for at, _ in raw], [float(at.min() < 20 and at.max() > 250) for at, _ in raw]], axis=1)
    got = toxicity.fit_chain([toxicity.chain_row(at, x, 2) for at, x in raw], marks)
    dim, fold, unseen = ftrl.DIM + 3, np.arange(90) % toxicity.FOLDS, np.zeros(90)
    bias = [(np.append(at, dim - 1), np.append(x, 1.0)) for at, x in raw]
    first = ftrl.fit(bias, marks[:, 0], dim, l1=2.0)
    for f in range(toxicity.FOLDS):
        w = ftrl.fit([bias[i] for i in np.flatnonzero(fold != f)], marks[fold != f, 0], dim, l1=2.0)
        for i in np.flatnonzero(fold == f):
            unseen[i] = w[bias[i][0]] @ bias[i][1]
    logit = np.log(ftrl.sigmoid(unseen).clip(1e-4, 1 - 1e-4) / (1 - ftrl.sigmoid(unseen).clip(1e-4, 1 - 1e-4))) / 4
    second = ftrl.fit([(np.append(at, ftrl.DIM), np.append(x, v)) for (at, x), v in zip(bias, logit)], marks[:, 1], dim, l1=2.0)
    assert got[0] == pytest.approx(first, abs=1e-5) and got[1] == pytest.approx(second, abs=1e-3)


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
