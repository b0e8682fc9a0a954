import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import attention, lm

WORD = re.compile("[^\x20\x09-\x0d]+")
END = object()


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [END]


def base(rows):
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    counts = Counter(w for r, h in zip(rows, held) if not h for w in words(r[1]))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for r, h in zip(rows, held):
        tokens = words(r[1])
        score = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
        out.append((r[0], h, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(score, 6)))
    return sorted(out, key=str)


@pytest.fixture(scope="module", autouse=True)
def quick():
    was, lm.MOST_ROUNDS = lm.MOST_ROUNDS, 2
    yield
    lm.MOST_ROUNDS = was


def told(out):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str)


def test_base_equals_brute_force(documents, rows):
    out = lm.score_documents(documents).collect()
    assert told(out) == base(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_base_by_shuffle(documents, rows):
    assert told(lm.score_documents(documents, broadcast_words=0).collect()) == base(rows)


def plain_within(texts, training, classes):
    """Sum of log10 of the shares of ids in their classes, by plain loops."""
    single = Counter(int(i) for t in training for i in t)
    behind = {1: {}, 2: {}}
    total = Counter()
    for i, kind in enumerate(classes):
        total[kind] += single[i] + 0.5

    def contexts(text):
        led = [None, None, *(int(i) for i in text)]
        for at, i in enumerate(led[2:]):
            if classes[i] >= attention.OWN_CLASSES:
                yield i, (classes[i], led[at + 1]), (classes[i], led[at], led[at + 1])

    for text in training:
        for i, one, two in contexts(text):
            behind[1].setdefault(one, Counter())[i] += 1
            behind[2].setdefault(two, Counter())[i] += 1
    out = []
    for text in texts:
        logs = 0.0
        for i, one, two in contexts(text):
            share = (single[i] + 0.5) / total[classes[i]]
            for counts in (behind[1].get(one, {}), behind[2].get(two, {})):
                kinds = max(1, len(counts))
                share = (counts.get(i, 0) + kinds * share) / (sum(counts.values()) + kinds)
            logs += math.log10(share)
        out.append(logs)
    return out


def test_ids_within_classes_equal_plain_loops(spark):
    """900 ids, most of which share a class; a hot id, an empty text and an equal one."""
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(60):
        at = rng.integers(0, 900, 120)
        at[rng.random(120) < 0.3] = 870
        texts.append([int(i) for a in at for i in (a, (a * 7 + 1) % 900)] + [lm.END])
    texts += [[lm.END], texts[0]]
    held = [k % 4 == 1 for k in range(len(texts))]
    data = [(k, h, bytearray(np.array(t, np.uint16).tobytes())) for k, (h, t) in enumerate(zip(held, texts))]
    encoded = spark.createDataFrame(data, "row long, held_out boolean, ids binary").repartition(3)
    counts, table = lm.count(encoded)
    training = [t for h, t in zip(held, texts) if not h]
    assert counts.single.sum() == sum(map(len, training))
    found = {r.row: r.within for r in lm.within_classes(encoded, table, counts).collect()}
    wanted = plain_within(texts, training, counts.classes.tolist())
    assert sum(w < -10 for w in wanted) > 50
    assert [found.get(k, 0.0) for k in range(len(texts))] == pytest.approx(wanted, rel=1e-9)


def test_only_counts_of_classes_and_ids_are_gathered(documents, monkeypatch):
    taken, packed = [], lm.packed

    def told_sizes(df):
        found = packed(df)
        taken.append((df.columns[0], max(int(k.max(initial=0)) for k in found[0])))
        return found

    monkeypatch.setattr(lm, "packed", told_sizes)
    lm.score_documents(documents).count()
    assert [name for name, _ in taken] == ["word", "id", "cell"]
    assert taken[2][1] < (attention.CLASSES + 1) ** 2 * attention.CLASSES


def test_packed_weights_and_schedule():
    p = attention.initial(3)
    again = attention.unpacked(attention.packed(p))
    assert list(again) == list(p) and all((again[k] == p[k]).all() for k in p)
    assert lm.schedule(0) == (2, 1)
    assert lm.schedule(1e12) == (2, lm.TRAIN_EVERY)
    assert lm.schedule(attention.STRIDE * 1_000_000) == (2, 10)


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    """Sentences whose words follow each other: words alone say less."""
    rng = np.random.default_rng(1)
    word = [chr(97 + a) + chr(97 + b) + "on" for a in range(8) for b in range(8)]
    rows = []
    for k in range(300):
        at, out = int(rng.integers(64)), []
        for _ in range(80):
            out.append(word[at])
            at = (at * 5 + 3 + int(rng.integers(2))) % 64
        rows.append((k, " ".join(out)))
    out = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("held_out").collect()
    assert len(out) > 20
    assert sum(r.score for r in out) > 0.7 * sum(r.base_score for r in out)


def test_no_rows_and_no_training_rows(spark, nothing):
    assert lm.score_documents(nothing).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    out = lm.score_documents(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).collect()
    assert told(out) == base([(held, "some words")]) and math.isfinite(out[0].score)


def some_cells(seed=0, vocabulary=600):
    rng = np.random.default_rng(seed)
    chain = rng.permutation(vocabulary)
    texts = []
    for _ in range(60):
        ids, at = [], int(rng.integers(vocabulary))
        for _ in range(int(rng.integers(1, 90))):
            ids.append(at)
            at = int(chain[at]) if rng.random() < 0.8 else int(rng.integers(vocabulary))
        texts.append(np.array(ids))
    classes = attention.classes_of(np.bincount(np.concatenate(texts), minlength=vocabulary).astype(float))
    return counted(texts, classes, vocabulary), texts


def counted(texts, classes, vocabulary):
    cells, n = np.unique(np.concatenate([attention.class_cells(t, classes) for t in texts]), return_counts=True)
    single = np.bincount(np.concatenate(texts), minlength=vocabulary).astype(float)
    return attention.Cells(single, attention.table_of([cells], [n]), classes)


def test_shares_add_up_to_one():
    """Behind any context, the probabilities of all ids are one in all."""
    cells, texts = some_cells()
    p, _ = attention.train(attention.initial(), texts[:20], cells)
    vocabulary = len(cells.single)
    for head in ([], [3], [5, 9, 100], texts[0].tolist()[:40]):
        every = [np.array([*head, k]) for k in range(vocabulary)]
        logs = attention.score(p, cells.counts(), every) + plain_within(every, texts, cells.classes.tolist())
        before = 0.0
        if head:
            before = attention.score(p, cells.counts(), [np.array(head)])[0] + plain_within([head], texts, cells.classes.tolist())[0]
        assert (10 ** (logs - before)).sum() == pytest.approx(1, abs=2e-3)


def test_every_token_is_scored_once():
    for n in (1, 15, 16, 17, 100):
        x, y, real = attention.windows(np.arange(n) % 50)
        assert real.sum() == n and list(y[real]) == list(np.arange(n) % 50)
        assert x.shape == (len(y), attention.CONTEXT)
        led = np.concatenate([np.full(attention.CONTEXT, attention.BEGIN), np.arange(n) % 50])
        at = 0
        for row, own in zip(x, real):  # the last inputs stand just before the targets
            for k in range(int(own.sum())):
                assert row[attention.CONTEXT - attention.STRIDE + k] == led[attention.CONTEXT + at - 1]
                at += 1


def test_what_lies_ahead_is_not_seen():
    cells, texts = some_cells(1)
    p, _ = attention.train(attention.initial(), texts[:10], cells)
    x, _, _ = attention.windows(cells.classes[texts[3]])
    g = attention.forward(p, x)["g"]
    changed = x.copy()
    changed[:, -1] = 7
    again = attention.forward(p, changed)["g"]
    assert np.allclose(g[:, :-1], again[:, :-1]) and not np.allclose(g[:, -1], again[:, -1])


def test_gradients_are_those_of_the_loss(monkeypatch):
    cells, texts = some_cells(2)
    counts = cells.counts()
    for name in ("groups", "members"):
        setattr(counts, name, getattr(counts, name).astype(np.float64))
    monkeypatch.setattr(attention, "MASK", attention.MASK.astype(np.float64))
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in attention.initial().items()}
    x, y, real = attention.windows(cells.classes[texts[0]])
    y = np.where(real, y, 0)
    _, grads = attention.gradients(p, counts, x, y, real)
    for name in p:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p[name].shape)
            losses = []
            for step in (1e-5, -2e-5):
                p[name][at] += step
                losses.append(attention.gradients(p, counts, x, y, real)[0])
            p[name][at] += 1e-5
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grads[name][at], abs=1e-6, rel=1e-4)


def test_counts_without_some_texts():
    cells, texts = some_cells(3)
    plain = counted(texts[10:], cells.classes, len(cells.single)).counts()
    without = cells.without(texts[:10])
    assert np.allclose(plain.groups, without.groups) and np.allclose(plain.members, without.members)


def test_attention_finds_what_counts_cannot():
    """Each id follows from the one four places before; two classes back say nothing."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(400):
        ids = rng.integers(0, 40, 4).tolist()
        for _ in range(60):
            ids.append((ids[-4] * 7 + 3) % 40)
        texts.append(np.array(ids))
    classes = attention.classes_of(np.bincount(np.concatenate(texts), minlength=40).astype(float))
    cells = counted(texts[:350], classes, 40)
    before = attention.score(attention.initial(), cells.counts(), texts[350:]).sum()
    p = attention.initial()
    for turn in range(12):
        p, _ = attention.train(p, texts[:350], cells, 1, turn)
    after = attention.score(p, cells.counts(), texts[350:]).sum()
    assert after > 0.6 * before  # both are negative: a smaller loss


def test_long_texts_are_cut_between_words():
    encode = lm.encoder(lm.TOKENIZER)
    text = " abcdef ghij" * 20_000
    assert (encode(text) == encode(" abcdef ghij" * 20_000)).all()
    whole = encode(" abcdef ghij")[:-1].tolist() * 20_000 + [lm.END]
    assert encode(text).tolist() == whole
    assert len(encode("x" * 200_000)) > 1 and encode("").tolist() == [lm.END]


@pytest.mark.parametrize("tokens", [0, attention.STRIDE * 1_000_000, 1e12])
def test_rounds_share_all_windows(tokens):
    """Every window of a text belongs to some round, however many there are."""
    rounds, every = lm.schedule(tokens)
    taken = [lm.turns(rounds, every, turn) for turn in range(rounds)]
    assert {(first + k) % every for first, share in taken for k in range(share)} == set(range(every))


def test_turns_see_every_window_once():
    cells, texts = some_cells()
    p = attention.initial()
    whole = attention.train(p, texts[:9], cells)[1]
    assert whole == sum(attention.train(p, texts[:9], cells, 16, first, turns=8)[1] for first in (0, 8)) > 0


def test_windows_are_held_in_a_few_bytes_a_token(monkeypatch):
    """Beside the class tables, training and scoring a long text take little more than its ids."""
    cells, texts = some_cells()
    monkeypatch.setattr(attention.Cells, "without", lambda self, own: self.counts())
    long, counts = np.tile(np.concatenate(texts), 400)[:400_000].astype(np.uint16), cells.counts()
    for run in (
        lambda: attention.score(attention.initial(), counts, [long]),
        lambda: attention.train(attention.initial(), [long], cells, 4, turns=1),
    ):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 12e6


class Held:
    def __init__(self, value):
        self.value = value


def test_a_task_sends_class_cells_once(monkeypatch):
    """However often its texts fill what it holds, and whatever four bytes can count."""
    cells, texts = some_cells(5)
    monkeypatch.setattr(lm, "HELD_CELLS", 200)
    batch = pa.RecordBatch.from_arrays([pa.array([t.astype(np.uint16).tobytes() for t in texts], pa.binary())], ["ids"])
    for most, times in ((1 << 31, 1), (900, 4)):
        monkeypatch.setattr(lm, "MOST_COUNTED", most)
        sent = list(lm._count_class_cells(Held(cells.classes))(iter([batch, batch])))
        twos = np.concatenate([b.column("two").to_numpy() for b in sent])
        assert max(Counter(twos.tolist()).values()) in range(times, 10 * times if times > 1 else 2)
        rows = pa.Table.from_batches(sent).sort_by("two").to_batches()
        summed = list(lm._sum_class_cells(iter(rows)))
        assert sum(b.num_rows for b in summed) == (cells.table > 0).sum()
        for b in summed:
            assert (b.column("n").to_numpy() == 2 * cells.table[b.column("cell").to_numpy()]).all()
    assert list(lm._sum_class_cells(iter([]))) == []


def test_numbers_leave_a_task_in_small_batches():
    columns = [np.arange(lm.SENT_ROWS * 2 + 5), np.arange(lm.SENT_ROWS * 2 + 5) * 3]
    sent = list(lm._sliced(columns, ["cell", "n"]))
    assert [b.num_rows for b in sent] == [lm.SENT_ROWS, lm.SENT_ROWS, 5]
    assert (np.concatenate([b.column("n").to_numpy() for b in sent]) == columns[1]).all()


def plain_forward(p, x):
    """Attention and the hidden layer, written out for one window at a time."""
    out = []
    for row in x:
        e = p["embed"][row] + p["place"]
        tail = e[-attention.STRIDE :]
        logits = (tail @ p["query"]) @ (e @ p["key"]).T / attention.DIM**0.5
        ahead = np.arange(attention.CONTEXT)[None] > (attention.CONTEXT - attention.STRIDE + np.arange(attention.STRIDE))[:, None]
        logits[ahead] = -np.inf
        weights = np.exp(logits - logits.max(-1, keepdims=True))
        weights /= weights.sum(-1, keepdims=True)
        h = tail + weights @ (e @ p["value"]) @ p["mix"]
        out.append(h + np.maximum(h @ p["up"] + p["up_bias"], 0) @ p["down"])
    return np.array(out)


@pytest.mark.parametrize("much", [1, 30])
def test_fast_forms_equal_the_plain_one(much):
    """Also where logits are too large for exp: with much larger queries."""
    cells, texts = some_cells(6)
    p, _ = attention.train(attention.initial(), texts[:20], cells)
    p["query"] = p["query"] * much**2
    x, _, _ = attention.windows(cells.classes[np.concatenate(texts[:9])])
    wanted = plain_forward({k: v.astype(np.float64) for k, v in p.items()}, x)
    assert np.allclose(attention.forward(p, x)["g"], wanted, atol=2e-3 * much)
    assert np.allclose(attention.Placed(p).forward(x).reshape(wanted.shape), wanted, atol=2e-3 * much)
