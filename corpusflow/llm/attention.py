"""A small causal self-attention model in numpy: one attention layer, one hidden layer.

The model sees subword ids through classes: frequent ids have their own, the others share
the rest. It predicts the class of the next token from up to CONTEXT tokens before it, as a
correction to how often the class followed the two before in the whole training split. The
token within its class is left to the caller, who counts ids behind ids.
Classes stand in GROUPS: the model chooses a group and then a class in it, so that a scored
token needs the shares of GROUPS + MEMBERS alternatives instead of all classes.

A text is cut into overlapping windows: each scores STRIDE tokens, every token once, and
begins CONTEXT - STRIDE tokens before them. Windows are batched; one mask keeps what lies
ahead, and in front of the text, out of sight.
"""

from __future__ import annotations

import zlib

import numpy as np

CONTEXT = 31  # tokens in a window
STRIDE = 16  # tokens scored by a window
OWN_CLASSES = 224
GROUPS, MEMBERS = 16, 16
CLASSES = GROUPS * MEMBERS
BEGIN = CLASSES  # input class in front of a text
CONTEXT_CELLS = (CLASSES + 1) * CLASSES  # class cells behind one class two before
DIM = 24
HIDDEN = 48
BATCH = 64  # windows of a training step
SCORED = 128  # windows scored at once
RATE = 8e-3
MUCH = 0.1

Parameters = dict[str, np.ndarray]


def classes_of(counts: np.ndarray) -> np.ndarray:
    """The class of each id: OWN_CLASSES most frequent ids alone, the others dealt by rank."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    found = np.empty(len(counts), np.int64)
    ranks = np.arange(len(counts))
    found[order] = np.where(ranks < OWN_CLASSES, ranks, OWN_CLASSES + ranks % (CLASSES - OWN_CLASSES))
    return found


class Cells:
    """Counts of a class behind two classes, as a table of all of them, and of ``single`` ids.

    The table's size is fixed by the classes, whatever was counted.
    """

    def __init__(self, single: np.ndarray, table: np.ndarray, classes: np.ndarray):
        self.single, self.table, self.classes = single, table, classes
        self._counts: Counts | None = None

    def counts(self) -> Counts:
        if self._counts is None:
            self._counts = Counts(self)
        return self._counts

    def without(self, texts: list[np.ndarray]) -> Counts:
        """Counts as if some of the counted texts had not been there."""
        if not texts:
            return self.counts()
        cells = np.concatenate([class_cells(t, self.classes).astype(np.int32) for t in texts])
        cells, n = np.unique(cells, return_counts=True)
        return Counts(self, cells, n, np.bincount(np.concatenate(texts), minlength=len(self.single)))

    def __getstate__(self) -> dict:
        # Most cells of the table are 0, so tasks are sent a small part of its size.
        packed = zlib.compress(self.table.tobytes(), 1)
        return self.__dict__ | {"_counts": None, "table": (self.table.dtype, self.table.nbytes, packed)}

    def __setstate__(self, state: dict) -> None:
        dtype, size, packed = state["table"]
        self.__dict__ |= state | {"table": np.frombuffer(zlib.decompress(packed, bufsize=size), dtype)}


def table_of(cells: list[np.ndarray], n: list[np.ndarray]) -> np.ndarray:
    """The table of distinct cells, four bytes a count where that is enough."""
    most = max((int(k.max()) for k in n if len(k)), default=0)
    table = np.zeros((CLASSES + 1) ** 2 * CLASSES, np.uint32 if most < 1 << 32 else np.int64)
    for at, k in zip(cells, n):
        table[at] = k
    return table


def class_cells(ids: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The cells of a text: two classes before and the class of each id."""
    two, one = before_classes(classes[ids])
    return (two * (CLASSES + 1) + one) * CLASSES + classes[ids]


def id_cells(ids: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Two ids before and the id, as one number, of the ids that share a class."""
    vocabulary = len(classes)
    led = np.concatenate([[vocabulary, vocabulary], ids])
    cells = (led[:-2] * (vocabulary + 1) + led[1:-1]) * vocabulary + ids
    return cells[classes[ids] >= OWN_CLASSES]


class Counts:
    """Smoothed shares of classes behind the two classes before, of all counted texts.

    ``less`` are sorted cells (see :func:`class_cells`) that count ``n`` times less, and
    ``less_single`` their ids. The less specific share weighs as much as a context has followers.
    Tables of all contexts are made one class at a time.
    """

    def __init__(self, counted: Cells, less: np.ndarray | None = None, n: np.ndarray | None = None, less_single=0):
        self.classes = counted.classes
        single, size = counted.single - less_single, (CLASSES + 1) * CLASSES
        total = np.bincount(self.classes, single + 0.5, minlength=CLASSES)
        edges = None if less is None else np.searchsorted(less, np.arange(CLASSES + 2) * size)

        def seen(k: int) -> np.ndarray:
            """Counts behind the class k two before."""
            part = counted.table[k * size : (k + 1) * size].astype(np.float64)
            if edges is not None:
                own = slice(edges[k], edges[k + 1])
                part[less[own] - k * size] -= n[own]
            return part.reshape(-1, CLASSES)

        shares = _smoothed(sum(seen(k) for k in range(CLASSES + 1)), total / total.sum())
        #: logs of the shares of each group behind the two classes before, and in each group
        self.groups = np.empty(((CLASSES + 1) ** 2, GROUPS), np.float32)
        self.members = np.empty(((CLASSES + 1) ** 2 * GROUPS, MEMBERS), np.float32)
        for k in range(CLASSES + 1):  # the class two before
            # A class may have no ids in a small vocabulary; it is next to impossible then.
            grouped = np.maximum(_smoothed(seen(k), shares), 1e-30).astype(np.float32).reshape(-1, GROUPS, MEMBERS)
            whole = np.log(grouped @ np.ones(MEMBERS, np.float32))
            rows = slice(k * (CLASSES + 1), (k + 1) * (CLASSES + 1))
            self.groups[rows] = whole
            within = np.log(grouped, out=grouped)
            within -= whole[..., None]
            self.members.reshape(-1, CLASSES)[rows] = within.reshape(-1, CLASSES)


def _smoothed(table: np.ndarray, less: np.ndarray) -> np.ndarray:
    kinds = np.maximum((table > 0).sum(1, keepdims=True), 1)
    return (table + kinds * less) / (table.sum(1, keepdims=True) + kinds)


def before_classes(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes two and one before each token of a text."""
    led = np.concatenate([[BEGIN, BEGIN], classes])
    return led[:-2], led[1:-1]


def initial(seed: int = 7) -> Parameters:
    rng = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    return {
        "embed": 0.3 * rng.standard_normal((CLASSES + 1, DIM)).astype(np.float32),
        "place": 0.1 * rng.standard_normal((CONTEXT, DIM)).astype(np.float32),
        "query": normal(DIM, DIM),
        "key": normal(DIM, DIM),
        "value": normal(DIM, DIM),
        "mix": 0.5 * normal(DIM, DIM),
        "up": normal(DIM, HIDDEN),
        "up_bias": np.zeros(HIDDEN, np.float32),
        "down": 0.5 * normal(HIDDEN, DIM),
        "group": np.zeros((DIM, GROUPS), np.float32),
        "member": np.zeros((DIM, CLASSES), np.float32),
    }


class Windows:
    """The windows of some texts, cut where they are asked for.

    The token at position p is the target of the input before it. Window k of a text scores the
    tokens from k x STRIDE on; rows of the inputs end one token before their last target. The
    classes of all texts lie in one row of two bytes each; a window is known by its place there.
    """

    def __init__(self, texts: list[np.ndarray], classes: np.ndarray):
        size = np.array([len(t) for t in texts], np.int64)
        #: how many windows each text has
        self.count = -(-size // STRIDE)
        room = CONTEXT + self.count * STRIDE
        begins = np.cumsum(room) - room
        self.row = np.full(room.sum(), BEGIN, np.uint16)
        for text, at in zip(texts, begins.tolist()):
            self.row[at + CONTEXT : at + CONTEXT + len(text)] = classes[text]
        k = np.arange(self.count.sum()) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.starts = np.repeat(begins, self.count) + k * STRIDE
        self.left = np.minimum(np.repeat(size, self.count) - k * STRIDE, STRIDE).astype(np.int8)

    def __len__(self) -> int:
        return len(self.starts)

    def cut(self, which) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs and targets of windows, and which targets are tokens of the text."""
        at = self.starts[which][:, None]
        x = self.row[at + np.arange(STRIDE - 1, STRIDE - 1 + CONTEXT)].astype(np.int64)
        y = self.row[at + np.arange(CONTEXT, CONTEXT + STRIDE)].astype(np.int64)
        return x, y, np.arange(STRIDE) < self.left[which][:, None]


def windows(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and which of them are tokens, of all windows of one text's classes."""
    return Windows([classes], np.arange(BEGIN + 1)).cut(slice(None))


def _mask() -> np.ndarray:
    """1 where a scored position may look, else 0; a row for each place that is looked at."""
    seen = np.arange(CONTEXT)[:, None] <= (CONTEXT - STRIDE + np.arange(STRIDE))[None, :]
    return seen.astype(np.float32)


MASK = _mask()
STEADY = 60.0  # logits up to this size need no shift before exp


def _times(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A product over the last axis as one matrix product."""
    return (x.reshape(-1, x.shape[-1]) @ weights).reshape(*x.shape[:-1], weights.shape[-1])


def _rows(table: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Rows of a table; ``take`` copies short rows several times faster than an index does."""
    return np.take(table, which.ravel(), axis=0).reshape(*which.shape, -1)


def _turned(x: np.ndarray) -> np.ndarray:
    """The last two axes changed over, as an array of its own: many small products are faster so."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def _looks(q: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much each place (rows) is looked at from each scored one, and the sums of that by scored place."""
    looks = k @ _turned(q)
    if -STEADY < looks.min(initial=0) and looks.max(initial=0) < STEADY:
        np.exp(looks, out=looks)
    else:
        looks -= np.where(MASK > 0, looks, -np.inf).max(1, keepdims=True)
        np.exp(np.minimum(looks, 0, out=looks), out=looks)
    looks *= MASK
    return looks, (np.ones(CONTEXT, looks.dtype) @ looks).reshape(-1, 1)


def _keys(p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """Weights of keys and values side by side, and those of scaled queries."""
    return np.concatenate([p["key"], p["value"]], 1), p["query"] * np.float32(DIM**-0.5)


def _over(p: Parameters, tail: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hidden layer over inputs and what attention adds to them: h, up, g, one row per token."""
    h = tail + mixed
    up = h @ p["up"]
    up += p["up_bias"]
    np.maximum(up, 0, out=up)
    g = up @ p["down"]
    g += h
    return h, up, g


def forward(p: Parameters, x: np.ndarray) -> dict[str, np.ndarray]:
    """Activations for inputs ``x`` (windows x CONTEXT); ``g`` for the last STRIDE places."""
    e = _rows(p["embed"], x)
    e += p["place"]
    tail = np.ascontiguousarray(e[:, CONTEXT - STRIDE :])
    keys, query = _keys(p)
    kv, q = _times(e, keys), _times(tail, query)
    looks, total = _looks(q, kv[..., :DIM])
    seen = (looks.transpose(0, 2, 1) @ kv[..., DIM:]).reshape(-1, DIM)
    seen /= total
    h, up, g = _over(p, tail.reshape(-1, DIM), seen @ p["mix"])
    return {"e": e, "tail": tail, "q": q, "kv": kv, "looks": looks, "total": total, "seen": seen, "h": h, "up": up, "g": g.reshape(tail.shape)}


def _alternatives(p: Parameters, counts: Counts, x: np.ndarray, y: np.ndarray, g: np.ndarray):
    """Logits of the groups, and of the members of each target's group, one row per token.

    The tokens stand in order of their group: their order comes third, then their activations
    ``g`` and the groups that are there with their rows.
    """
    group = y.ravel() // MEMBERS
    order = np.argsort(group.astype(np.uint8), kind="stable")
    group, flat = group[order], _rows(g.reshape(-1, DIM), order)
    cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    parts = [(slice(k * MEMBERS, (k + 1) * MEMBERS), slice(a, b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    context = (x[:, CONTEXT - STRIDE - 1 : -1] * (CLASSES + 1) + x[:, CONTEXT - STRIDE :]).ravel()[order]
    of_groups = flat @ p["group"]
    of_groups += _rows(counts.groups, context)
    of_members = _rows(counts.members, context * GROUPS + group)
    for own, rows in parts:
        of_members[rows] += flat[rows] @ p["member"][:, own]
    return of_groups, of_members, order, flat, parts


def _chosen(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural logs of the share of the chosen alternatives, and all shares times a sum by row.

    The logits are logs of shares with corrections, so they need no shift before exp.
    """
    picked = logits.ravel()[np.arange(0, logits.size, logits.shape[1]) + at]
    shares = np.exp(logits, out=logits)
    total = shares @ np.ones(shares.shape[1], shares.dtype)
    return picked - np.log(total), shares, total


def gradients(
    p: Parameters, counts: Counts, x: np.ndarray, y: np.ndarray, real: np.ndarray, out: Parameters | None = None
) -> tuple[float, Parameters]:
    """Mean loss in nats and its gradients, in the arrays of ``out`` if they are given."""
    out = {name: np.empty_like(part) for name, part in p.items()} if out is None else out
    a = forward(p, x)
    of_groups, of_members, order, g, parts = _alternatives(p, counts, x, y, a["g"])
    y, real = y.ravel()[order], real.ravel()[order]
    group, member = y // MEMBERS, y % MEMBERS
    log_group, d_group, of_group = _chosen(of_groups, group)
    log_member, d_member, of_member = _chosen(of_members, member)
    n = max(1, int(real.sum()))
    loss = -float((log_group + log_member)[real].sum()) / n
    weight = (real / n).astype(d_group.dtype)
    for shares, total, chosen in ((d_group, of_group, group), (d_member, of_member, member)):
        shares *= (weight / total)[:, None]
        shares.ravel()[np.arange(0, shares.size, shares.shape[1]) + chosen] -= weight
    flat = lambda z: z.reshape(-1, z.shape[-1])
    np.matmul(g.T, d_group, out=out["group"])
    out["member"][...] = 0
    dg_ordered = d_group @ p["group"].T
    for own, rows in parts:
        out["member"][:, own] = g[rows].T @ d_member[rows]
        dg_ordered[rows] += d_member[rows] @ p["member"][:, own].T
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    dg = _rows(dg_ordered, back)
    np.matmul(a["up"].T, dg, out=out["down"])
    dup = dg @ p["down"].T
    dup *= a["up"] > 0
    np.matmul(a["h"].T, dup, out=out["up"])
    np.matmul(np.ones(len(dup), dup.dtype), dup, out=out["up_bias"])
    dh = dg
    dh += dup @ p["up"].T
    np.matmul(a["seen"].T, dh, out=out["mix"])
    # Through the sums of looks: their share of a row is what the row as a whole says.
    dseen = dh @ p["mix"].T
    dseen /= a["total"]
    whole = np.einsum("ij,ij->i", dseen, a["seen"]).reshape(len(x), 1, STRIDE)
    dseen = dseen.reshape(len(x), STRIDE, DIM)
    k, v = a["kv"][..., :DIM], a["kv"][..., DIM:]
    dlooks = v @ _turned(dseen)
    dlooks -= whole
    dlooks *= a["looks"]
    dkv = np.empty_like(a["kv"])
    np.matmul(dlooks, a["q"], out=dkv[..., :DIM])
    np.matmul(a["looks"], dseen, out=dkv[..., DIM:])
    dq = dlooks.transpose(0, 2, 1) @ k
    keys, query = _keys(p)
    np.matmul(flat(a["tail"]).T, flat(dq), out=out["query"])
    out["query"] *= np.float32(DIM**-0.5)
    dkeys = flat(a["e"]).T @ flat(dkv)
    out["key"][...], out["value"][...] = dkeys[:, :DIM], dkeys[:, DIM:]
    de = _times(dkv, keys.T)
    dh += flat(dq) @ query.T
    de[:, CONTEXT - STRIDE :] += dh.reshape(dq.shape)
    np.matmul(np.ones(len(x), de.dtype), de.reshape(len(x), -1), out=out["place"].reshape(-1))
    order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
    known = x.ravel()[order]
    new = np.flatnonzero(np.append(True, known[1:] != known[:-1]))
    out["embed"][...] = 0
    out["embed"][known[new]] = np.add.reduceat(_rows(flat(de), order), new)
    return loss, out


def train(
    p: Parameters, texts: list[np.ndarray], cells: Cells, every: int = 1, first: int = 0, rate: float = RATE, turns: int = 1
) -> tuple[Parameters, int]:
    """One pass of Adam over windows of some counted texts: the weights, and how many windows there were.

    Of all windows those numbered ``first``, ``first + every`` and so on are taken, then in as many
    turns as asked for those that begin at the numbers after ``first``. They are seen
    with counts that leave their texts out, so that the weights learn to correct counts as they are
    for texts that were not counted. Texts that are much of all are left out in two parts.
    """
    rng, like = np.random.default_rng(first), initial()
    row = packed(p).astype(np.float32)
    p, mean, square = unpacked(row, like), np.zeros_like(row), np.zeros_like(row)
    g, step = np.empty_like(row), np.empty_like(row)
    grads = unpacked(g, like)
    done = seen = passed = 0
    much = sum(map(len, texts)) > MUCH * cells.single.sum()
    for own in (texts[::2], texts[1::2]) if much else (texts,):
        every_one = Windows(own, cells.classes)
        counts, numbers = None, np.arange(passed, passed + len(every_one))
        passed += len(every_one)
        for turn in range(first, first + turns):
            order = np.flatnonzero(numbers % every == turn % every)
            if not len(order):
                continue
            counts = cells.without(own) if counts is None else counts
            rng.shuffle(order)
            seen += len(order)
            for at in range(0, len(order), BATCH):
                x, y, real = every_one.cut(order[at : at + BATCH])
                y *= real
                gradients(p, counts, x, y, real, grads)
                done += 1
                warm = rate * min(1.0, done / 50)
                mean *= 0.9
                mean += np.multiply(g, 0.1, out=step)
                g *= g
                square *= 0.98
                square += np.multiply(g, 0.02, out=step)
                np.sqrt(np.divide(square, 1 - 0.98**done, out=step), out=step)
                step += 1e-8
                np.divide(mean, step, out=step)
                step *= warm / (1 - 0.9**done)
                row -= step
    return p, seen


def packed(p: Parameters) -> np.ndarray:
    """All weights as one row of numbers, in the order of :func:`initial`."""
    return np.concatenate([p[name].ravel() for name in initial()])


def unpacked(row: np.ndarray, like: Parameters | None = None) -> Parameters:
    """The weights of a row; where its numbers have four bytes, they are those of the row itself."""
    p, at = {}, 0
    for name, form in (like or initial()).items():
        p[name] = row[at : at + form.size].reshape(form.shape).astype(np.float32, copy=False)
        at += form.size
    return p


class Placed:
    """Weights that no longer change, multiplied out for each class at each place of a window."""

    def __init__(self, p: Parameters):
        self.p = p
        e = p["embed"][:, None] + p["place"]
        keys, query = _keys(p)
        keys[:, DIM:] = keys[:, DIM:] @ p["mix"]
        tail = e[:, CONTEXT - STRIDE :]
        #: keys and mixed values by class and place, inputs and queries by class and scored place
        self.keys = _times(e, keys).reshape(-1, 2 * DIM)
        self.tail = np.concatenate([tail, _times(tail, query)], -1).reshape(-1, 2 * DIM)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """What ``g`` of :func:`forward` is, one row per token."""
        kv = _rows(self.keys, x * CONTEXT + np.arange(CONTEXT))
        tail = _rows(self.tail, x[:, CONTEXT - STRIDE :] * STRIDE + np.arange(STRIDE))
        looks, total = _looks(tail[..., DIM:], kv[..., :DIM])
        mixed = (looks.transpose(0, 2, 1) @ kv[..., DIM:]).reshape(-1, DIM)
        mixed /= total
        return _over(self.p, tail[..., :DIM].reshape(-1, DIM), mixed)[2]


def score(p: Parameters, counts: Counts, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of the classes of each text, an array of ids."""
    total, placed = np.zeros(len(texts)), Placed(p)
    made = Windows(texts, counts.classes)
    owner = np.repeat(np.arange(len(texts)), made.count)
    for a in range(0, len(made), SCORED):
        x, y, real = made.cut(slice(a, a + SCORED))
        y *= real
        of_groups, of_members, order, _, _ = _alternatives(p, counts, x, y, placed.forward(x))
        target, logs = y.ravel()[order], np.empty(y.size)
        logs[order] = _chosen(of_groups, target // MEMBERS)[0] + _chosen(of_members, target % MEMBERS)[0]
        logs *= real.ravel()
        part = logs.reshape(-1, STRIDE).sum(-1)
        total += np.bincount(owner[a : a + SCORED], part, minlength=len(texts)) / np.log(10)
    return total
