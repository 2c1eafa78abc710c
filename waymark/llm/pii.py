"""Personal data by base patterns and a skip-chain conditional random field.

Base spans are exact pattern matches and always stay. Further spans come from a
graph per document: its nodes are the base spans (their label is known) and other
number-like or address-like strings (their label is hidden). Neighbours in the
text share a chain potential; strings with the same key (the same digits, the
same address or mailbox name) share a skip potential however far apart they are.
Mentions of one string are one variable, observed once, so that repeats of a number
don't outvote the label that it has elsewhere.
Loopy belief propagation spreads the known labels, so a number that is a phone
number in one place is one elsewhere; only strings that skip potentials join to a known
label, directly or through others, or that pass a checksum, can get a span. The potentials are trained by
pseudo-likelihood over the whole corpus: each labelled string is predicted from its form (without
the mark that made a pattern match it) and from the labels around it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.store import small_batches, text_or_empty
from waymark.llm.words import without_nulls

#: The kinds in their order, and what their patterns are made of.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_RUN = re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}[0-9][0-9().\-/]*(?: [0-9().\-/]+)*(?<=[0-9])(?![0-9A-Za-z])")
_PIECE = re.compile(r"[^ ]+")
_SPOKEN = re.compile(
    r"([A-Za-z0-9._%+-]{2,64}) ?(?:\(at\)|\[at\]|@) ?([A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}){1,8})", re.I
)
_WORD = re.compile(r"[A-Za-z0-9._%+-]{5,}")
#: Rounds end when no message moves by more than SETTLED; ROUNDS only stops graphs that never settle.
ROUNDS, SETTLED, THRESHOLD = 1000, 1e-4, 0.5

#: Cards: their form has a checksum, which is evidence by itself.
_CHECKED = 3

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches around each @; a mailbox name starts where its run of characters does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of every base match, by kind and start; ends are exclusive code points."""
    found: list[Span] = []
    if "@" in text:
        found += [(1, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((2, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((3, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((4, m.start(), m.end()))
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _shape(text: str) -> str:
    """What a string looks like, the observation of its node."""
    digits = _digits(text)
    if "@" in text or not digits or any(c.isalpha() for c in text):
        return "address"
    dotted = text.count(".") == 3 and len(text.split(".")) == 4
    return f"n{min(len(digits), 20)}{'+' if text[0] == '+' else ''}{'i' if dotted else ''}{'v' if 16 <= len(digits) <= 19 and luhn(digits) else ''}"


def _address_key(local: str, domain: str) -> str:
    domain = re.sub(r" ?(?:\(dot\)|\[dot\]|\.) ?", ".", domain, flags=re.I)
    return f"{local}@{domain}".lower()


def graph_nodes(text: str, base: list[Span]) -> list[tuple[int, int, int, tuple[str, ...], str]]:
    """Nodes (start, end, known label or -1, keys, shape) in text order.

    Hidden nodes are number-like runs of at least 7 digits and their pieces between
    spaces, addresses in a spoken form, and words equal to the mailbox name of a
    base address. None overlaps a base span.
    """
    nodes = []
    mailboxes = set()
    for kind, a, b in base:
        part = text[a:b]
        if kind == 1:
            local, _, domain = part.partition("@")
            keys = (_address_key(local, domain), "m:" + local.lower())
            if len(local) >= 5 and any(not c.isalpha() for c in local):
                mailboxes.add(local.lower())
        else:
            keys = _number_keys(part)
        nodes.append((a, b, kind, keys, _shape(part)))
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    # the furthest end of the base spans up to each; spans of different kinds may overlap
    until = list(accumulate((b for _, b in taken), max))

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i == 0 or until[i - 1] <= a

    if _DIGIT.search(text):
        for m in _RUN.finditer(text):
            spans = {(m.start(), m.end())}
            if " " in m[0]:
                spans |= {(m.start() + p.start(), m.start() + p.end()) for p in _PIECE.finditer(m[0])}
            for a, b in spans:
                keys = _number_keys(text[a:b])
                if keys and free(a, b):
                    nodes.append((a, b, -1, keys, _shape(text[a:b])))
    if mailboxes:
        spoken = [m for m in _SPOKEN.finditer(text) if free(m.start(), m.end())]
        heads, ends = [m.start() for m in spoken], [m.end() for m in spoken]
        covered = lambda at: bool((i := bisect_right(heads, at)) and at < ends[i - 1])
        for m in spoken:
            nodes.append((m.start(), m.end(), -1, (_address_key(m[1], m[2]),), "address"))
        for m in _WORD.finditer(text):
            word = m[0].rstrip(".")
            if word.lower() in mailboxes and not covered(m.start()) and free(m.start(), m.start() + len(word)) and text[m.end() : m.end() + 1] != "@":
                nodes.append((m.start(), m.start() + len(word), -1, ("m:" + word.lower(),), "address"))
    nodes.sort(key=lambda n: n[:3])
    return nodes


def _number_keys(text: str) -> tuple[str, ...]:
    """All digits, and the last nine of longer numbers, which a country code may precede."""
    digits = _digits(text)
    if len(digits) < 7:
        return ()
    return (digits, "s:" + digits[-9:]) if 9 <= len(digits) <= 15 else (digits,)


def _edges(nodes: list) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between consecutive nodes, skip edges between consecutive holders of a key."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1)]
    last: dict[str, int] = {}
    skip = set()
    for i, node in enumerate(nodes):
        for key in node[3]:
            if key in last:
                skip.add((last[key], i))
            last[key] = i
    return chain, sorted(skip)


def _variables(nodes: list) -> tuple[list[int], list, dict[tuple[int, int], float], list[tuple[int, int]]]:
    """Each node's variable, a node of each variable, weighted chain edges, and skip edges.

    Nodes of equal label, keys and shape are one variable. A hidden one is tied to every
    label known for one of its keys, and to the hidden one before it; the chain edges of a
    variable weigh no more than those of a single mention. All is linear in the nodes.
    """
    number: dict[tuple, int] = {}
    variables, variable = [], []
    for node in nodes:
        at = number.setdefault(node[2:], len(variables))
        if at == len(variables):
            variables.append(node)
        variable.append(at)
    mentions = Counter(variable)
    met = Counter((min(a, b), max(a, b)) for a, b in zip(variable[:-1], variable[1:], strict=True) if a != b)
    chain = {(a, b): n / max(mentions[a], mentions[b]) for (a, b), n in met.items()}
    known: dict[str, dict[int, int]] = {}
    for i, node in enumerate(variables):
        if node[2] > 0:
            for key in node[3]:
                known.setdefault(key, {}).setdefault(node[2], i)
    last: dict[str, int] = {}
    skip = set()
    for i, node in enumerate(variables):
        if node[2] < 0:
            ties: dict[int, int] = {}
            for key in node[3]:
                ties = known.get(key, {}) | ties
                if key in last:
                    skip.add((last[key], i))
                last[key] = i
            skip.update((j, i) for j in ties.values())
    return variable, variables, chain, sorted(skip)


def _form(shape: str) -> str:
    """What the form allows besides none, as digits of the kinds: the observation of a string, a plus sign left out."""
    if shape == "address":
        return "1"
    digits = int(re.match(r"n([0-9]+)", shape)[1])
    return ("2" if "i" in shape else "") + ("3" if "v" in shape else "") + ("4" if 8 <= digits <= 15 else "")


def examples(text: str) -> list[tuple[str, int, int, int]]:
    """(form, label, labels beside it, labels of the same string) of every labelled string; sets of labels are bit masks.

    Base spans have their kind. A number that shares no string with any is none; one that
    does, one that passes the checksum, and addresses in other forms are unlabelled.
    """
    nodes = graph_nodes(text, base_spans(text))
    named = {key for n in nodes if n[2] > 0 for key in n[3]}
    unsure = lambda n: n[4] == "address" or "v" in n[4] or bool(named.intersection(n[3]))
    label = [n[2] if n[2] > 0 else None if unsure(n) else 0 for n in nodes]
    masks = [[0, 0] for _ in nodes]
    for which, edges in enumerate(_edges(nodes)):
        for a, b in edges:
            for i, j in ((a, b), (b, a)):
                if label[j] is not None:
                    masks[i][which] |= 1 << label[j]
    return [(_form(n[4]), y, *m) for n, y, m in zip(nodes, label, masks, strict=True) if y is not None]


def learn(docs: DataFrame, text_col: str = "text") -> list[tuple[str, int, int, int, int]]:
    """Examples over all documents with their counts: as many rows as there are forms, labels and sets of labels, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in without_nulls(batch.column(0)).to_pylist():
                if "@" in text or _DIGIT.search(text):
                    seen.update(examples(text))
        columns = list(zip(*((*k, n) for k, n in seen.items()), strict=True)) or [[]] * 5
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["form", "label", "beside", "same", "n"])

    rows = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(count, "form string, label int, beside int, same int, n long")
    found = rows.groupBy("form", "label", "beside", "same").agg(F.sum("n").alias("n"))
    return sorted(tuple(r) for r in found.collect())


class Field:
    """Potentials fitted to examples by pseudo-likelihood under a Gaussian prior.

    The score of a label is its form's weight, plus one weight for every label beside it
    and every label of the same string; both tables of weights are symmetric.
    """

    def __init__(self, seen: list[tuple[str, int, int, int, int]], steps: int = 600, prior: float = 1.0):
        k = len(LABELS)
        forms = sorted({r[0] for r in seen})
        place = {f: i for i, f in enumerate(forms)}
        form = np.array([place[r[0]] for r in seen], np.int64)
        label = np.array([r[1] for r in seen], np.int64)
        bits = lambda at: np.array([[r[at] >> j & 1 for j in range(k)] for r in seen], float).reshape(-1, k)
        beside, same, n = bits(2), bits(3), np.array([r[4] for r in seen], float)
        allowed = np.array([[y == 0 or str(y) in f for y in range(k)] for f in forms]).reshape(-1, k)
        params = [np.zeros((len(forms), k)), np.zeros((k, k)), np.zeros((k, k))]
        moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        total = max(n.sum(), 1.0)
        truth = np.eye(k)[label].reshape(-1, k)
        for step in range(1, steps + 1 if len(seen) else 1):
            score = np.where(allowed[form], params[0][form] + beside @ params[1] + same @ params[2], -1e9)
            score = np.exp(score - score.max(1, keepdims=True))
            error = (truth - score / score.sum(1, keepdims=True)) * n[:, None]
            grads = [np.zeros_like(params[0]), beside.T @ error, same.T @ error]
            np.add.at(grads[0], form, error)
            grads[1:] = [g + g.T for g in grads[1:]]
            for p, (g, weight) in enumerate(zip(grads, (0.1, prior, prior), strict=True)):
                g = (g - weight * params[p]) / total
                moment[p] = 0.9 * moment[p] + 0.1 * g
                square[p] = 0.999 * square[p] + 0.001 * g * g
                rate = 0.1 * 0.5 ** (4 * step / steps)
                params[p] += rate * (moment[p] / (1 - 0.9**step)) / (np.sqrt(square[p] / (1 - 0.999**step)) + 1e-12)
        self.unary = {f: np.where(allowed[i], params[0][i], -30.0) for f, i in place.items()}
        self.chain, self.skip = params[1], params[2]

    def observe(self, shape: str) -> np.ndarray:
        """The weights of a form; one that was never seen has even odds among what it allows."""
        form = _form(shape)
        return self.unary[form] if form in self.unary else np.array([0.0 if y == 0 or str(y) in form else -30.0 for y in range(len(LABELS))])


def beliefs(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals of loopy sum-product belief propagation, damped; edges are rows (a, b)."""
    n, k = unary.shape
    a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    half = len(edges)
    table = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    message = np.zeros((len(a), k))
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, b, message)
        rest = total[a] - message[back]
        fresh = rest[:, :, None] + table
        top = fresh.max(1)
        fresh = top + np.log(np.exp(fresh - top[:, None, :]).sum(1))
        fresh -= fresh.max(1, keepdims=True)
        step = 0.7 * (fresh - message)
        message = message + step
        if np.abs(step).max() < SETTLED:
            break
    total = unary.copy()
    np.add.at(total, b, message)
    total -= total.max(1, keepdims=True)
    p = np.exp(total)
    return p / p.sum(1, keepdims=True)


def _reached(count: int, known: list[int], skip: list[tuple[int, int]]) -> list[bool]:
    """Which variables skip edges join to a known one, directly or through others."""
    near: list[list[int]] = [[] for _ in range(count)]
    for a, b in skip:
        near[a].append(b)
        near[b].append(a)
    out = [False] * count
    stack = list(known)
    while stack:
        at = stack.pop()
        if not out[at]:
            out[at] = True
            stack += near[at]
    return out


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Spans of hidden nodes that the field labels with a kind; of overlapping ones the likeliest stays."""
    nodes = graph_nodes(text, base) if base else []
    if not any(n[2] < 0 for n in nodes):
        return []
    k = len(LABELS)
    variable, variables, chain, skip = _variables(nodes)
    reached = _reached(len(variables), [i for i, n in enumerate(variables) if n[2] > 0], skip)
    unary = np.stack([field.observe(n[4]) if n[2] < 0 else np.where(np.arange(k) == n[2], 0.0, -30.0) for n in variables])
    edges = np.asarray([*chain, *skip], np.int64).reshape(-1, 2)
    weight = np.asarray(list(chain.values())).reshape(-1, 1, 1)
    potentials = np.concatenate([field.chain * weight, np.broadcast_to(field.skip, (len(skip), k, k))])
    p = beliefs(unary, edges, potentials) if len(edges) else np.exp(unary) / np.exp(unary).sum(1, keepdims=True)
    picks = []
    for node, at in zip(nodes, variable, strict=True):
        kind = int(p[at].argmax())
        if node[2] < 0 and kind and (reached[at] or kind == _CHECKED) and p[at][kind] > THRESHOLD:
            picks.append((-float(p[at][kind]), node[0] - node[1], kind, node[0], node[1]))
    starts: list[int] = []
    chosen: dict[int, Span] = {}
    for _, _, kind, a, b in sorted(picks):
        # the chosen spans don't overlap, so only the neighbours by start can touch
        i = bisect_left(starts, a)
        if (i == 0 or chosen[starts[i - 1]][2] <= a) and (i == len(starts) or b <= starts[i]):
            starts.insert(i, a)
            chosen[a] = (kind, a, b)
    return [chosen[a] for a in starts]


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k - 1]}:{a}:{b}" for k, a, b in sorted(spans))


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts of base spans by kind, their digest, and all spans.

    Offsets are code points, ends exclusive. Null and empty texts have no spans (and
    the digest of nothing). Of overlapping added spans the likeliest stays; ties go to the
    longer, then the kind, then the place. Repeated rows and null ids are rows like others; an
    empty table gives an empty result; other columns are ignored. A very long text is a graph of
    its own, in time and memory near linear in its strings.
    """
    small_batches(docs.sparkSession)
    field = Field(learn(docs, text_col))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in without_nulls(batch.column(1)).to_pylist():
                base = base_spans(text)
                counts = [sum(s[0] == k for s in base) for k in (1, 2, 3, 4)] if base else [0, 0, 0, 0]
                digest = hashlib.sha256(_written(base).encode()).hexdigest()
                rows.append((*counts, digest, _written(base + added_spans(text, base, field))))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [*[pa.int64()] * 4, pa.string(), pa.string()]
            names = ["id", *[p.split()[0] for p in _FOUND.split(", ")]]
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)

    slim = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(find, f"id {kind}, {_FOUND}").withColumnRenamed("id", id_col)


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, done = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
            done = b
    return "".join([*out, text[done:]])
