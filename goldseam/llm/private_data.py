"""Personal data: fixed patterns, and a skip-chain conditional random field for what they miss.

Nodes of the field are the tokens with a digit or an "@"; all others are outside.
Neighbouring nodes are linked, and so are, however far apart, consecutive nodes of a
document that are the same token, have the same digits, end numbers with the same
last seven digits, or have the same name before an "@". So "+1 (803) 555-5351" in one
place makes "803-555-5351" a phone in another. Labels are found by loopy sum-product
message passing over all documents of a batch at once.

The patterns' spans are the truth to learn from, and each carries the mark that its
pattern needs. What the field is for are mentions without it. So, for fitting, spans
of the sample are mentioned again without their marks, beside numbers and names of the
same form, twice each, that nothing else in the document bears out: the form alone then
tells nothing, and the links have to. Token weights are a multinomial logistic regression,
link weights smoothed log ratios of label pairs.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import uniform, whole

KINDS = ("email", "ip", "card", "phone")
#: The field is fitted on the documents with the least hashes, so many at most. Of a document with more than
#: SAMPLE_NODES nodes, in whole text, those count whose keys have the least hashes, so that linked nodes stay together;
#: up to PLANTS of its spans, by hash, are mentioned again.
SAMPLE_DOCS, SAMPLE_NODES, PLANTS = 2_000, 200, 6
ROUNDS, CERTAIN = 10, 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_DIGIT = re.compile("[0-9]")
_EDGES = ".,;:!?\"'()[]{}<>|"
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small_part(part: str) -> bool:
    """At most 255, for a part of any length."""
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without overlaps, found from each "@", in linear time for any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by the fixed patterns, ordered."""
    spans = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(small_part(p) for p in m[0].split(".")):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                spans.append((3, *m.span()))
    return spans


@dataclass
class Nodes:
    """The nodes of some documents: document, offsets, features, and labels where patterns match (0: outside)."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    truth: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


#: Bits of the shape; the last is always set.
_SHAPES = 31


def shape(token: str, before: str, after: str) -> list[int]:
    """Features of a token: what it is made of, how long, and whether digits stand beside it."""
    body = token.strip(_EDGES)
    digits = sum("0" <= c <= "9" for c in body)
    length = len(body)
    on = [
        "@" in body, body[:1] == "+", token[:1] == "(", "-" in body, body.count(".") == 1, body.count(".") == 2,
        body.count(".") == 3, body.count(".") > 3, digits == length, digits == 0, any(c.isalpha() for c in body),
        any(c in "=:/_#%" for c in body), before[-1:].isdigit(), after[:1].isdigit(), before[:1] == "+", after[:1] == "(",
    ]
    on += [digits == n for n in (1, 2, 3, 4)] + [5 <= digits <= 6, 7 <= digits <= 8, 9 <= digits <= 12, 13 <= digits <= 19, digits > 19]
    on += [length <= 4, 5 <= length <= 8, 9 <= length <= 16, length > 16]
    on += [13 <= digits <= 19 and luhn("".join(_DIGIT.findall(body)))]
    return [*(int(x) for x in on), *[0] * (_SHAPES - 1 - len(on)), 1]


def _consecutive(doc: np.ndarray, keys: list[str]) -> np.ndarray:
    """Pairs of consecutive nodes of a document with the same key; empty keys link nothing."""
    order = sorted((i for i, k in enumerate(keys) if k), key=lambda i: (doc[i], keys[i], i))
    pairs = [(a, b) for a, b in zip(order, order[1:], strict=False) if doc[a] == doc[b] and keys[a] == keys[b]]
    return np.array(pairs, np.int64).reshape(-1, 2)


def _name(body: str) -> str:
    """What stands before an "@", else the token: of at least four characters with a digit or a dot."""
    name = body.lower().split("@")[0]
    return name if len(name) >= 4 and ("@" in body or "." in name) else ""


def nodes_of(texts: list[str], spans: list[list[Span]], most: int | None = None) -> Nodes:
    """The nodes of some texts; ``most`` of each, chosen by the hashes of their keys."""
    doc, start, end, features, truth, chain = [], [], [], [], [], []
    keys: list[list[str]] = [[], [], [], []]
    for d, text in enumerate(texts):
        found = [(m.start(), m.end()) for m in _TOKEN.finditer(text)] if "@" in text or _DIGIT.search(text) else []
        tokens = [text[a:b] for a, b in found]
        digits = ["".join(_DIGIT.findall(t)) for t in tokens]
        tails = _tails(found, digits)
        taken = range(len(found))
        if most is not None and len(found) > most:
            taken = sorted(sorted(taken, key=lambda i: (_lot(tails[i] or digits[i] or tokens[i]), i))[:most])
        kinds = sorted((a, b, k + 1) for k, a, b in spans[d])
        at, last = 0, -2
        for i in taken:
            (a, b), token = found[i], tokens[i]
            while at < len(kinds) and kinds[at][1] <= a:
                at += 1
            hit = [k for x, y, k in kinds[at : at + 4] if x < b and a < y]
            before = tokens[i - 1] if i and found[i - 1][1] + 1 == a else ""
            after = tokens[i + 1] if i + 1 < len(found) and b + 1 == found[i + 1][0] else ""
            if before and last == i - 1:
                chain.append((len(doc) - 1, len(doc)))
            last, body = i, token.strip(_EDGES)
            doc.append(d)
            start.append(a)
            end.append(b)
            features.append(shape(token, before, after))
            truth.append(hit[0] if hit else 0)
            for held, key in zip(keys, (body.lower(), digits[i] if len(digits[i]) >= 4 else "", tails[i], _name(body)), strict=True):
                held.append(key)
    doc_of = np.array(doc, np.int64)
    skip = np.concatenate([_consecutive(doc_of, k) for k in keys])
    return Nodes(
        doc_of, np.array(start, np.int64), np.array(end, np.int64), np.array(features, np.float64).reshape(-1, _SHAPES),
        np.array(truth, np.int64), np.array(chain, np.int64).reshape(-1, 2), np.unique(skip, axis=0),
    )


def _lot(key: str) -> bytes:
    return hashlib.sha256(key.encode("utf-8", "surrogatepass")).digest()


def _tails(found: list[tuple[int, int]], digits: list[str]) -> list[str]:
    """For the last token of a run of neighbours, the last seven digits of the run, if it has so many; else ''."""
    tails, run = [""] * len(found), ""
    for i, (_, b) in enumerate(found):
        run = (run + digits[i])[-7:]
        if i + 1 == len(found) or found[i + 1][0] != b + 1:
            tails[i], run = run if len(run) == 7 else "", ""
    return tails


def planted(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """The text with some of its spans mentioned again without the patterns' marks, each beside one that is made up.

    Returns the new spans as well; what is made up has none. The same text gives the same.
    """
    pick = random.Random(_lot(text))
    chosen = [s for s in spans if KINDS[s[0]] != "ip"]
    chosen = sorted(pick.sample(chosen, min(PLANTS, len(chosen))))
    parts, found, at = [text], [], len(text)
    for kind, a, b in chosen:
        body = text[a:b]
        if KINDS[kind] == "phone":
            digits = "".join(_DIGIT.findall(body))[-10:]
            other = "".join(pick.choice("0123456789") for _ in digits)
            form = pick.randrange(3)
            true, false = (
                x if form == 0 else f"{x[:-7]}-{x[-7:-4]}-{x[-4:]}" if form == 1 else f"({x[:-7]}) {x[-7:-4]}-{x[-4:]}"
                for x in (digits, other)
            )
        elif KINDS[kind] == "card":
            # Behind another number the pattern takes both for one, which is no card.
            lead, digits = pick.randrange(10, 100), "".join(_DIGIT.findall(body))
            true, false = f"{lead} {digits}", f"{lead} {digits[:-1]}{(int(digits[-1]) + 1 + pick.randrange(9)) % 10}"
        else:
            name, domain = body.split("@")
            first = domain.split(".")[0]
            true, false = f"{name}@{first}", f"{''.join(pick.choice('abcdefgh') for _ in range(6))}{pick.randrange(100)}@{first}"
        # What is made up comes twice: that a form comes again must not bear it out.
        for mention, known in pick.sample([(true, True), (false, False), (false, False)], 3):
            parts.append("\nas well " + mention)
            at += len("\nas well ")
            if known:
                found.append((kind, at + (3 if KINDS[kind] == "card" else 0), at + len(mention)))
            at += len(mention)
    return "".join(parts), found


@dataclass(frozen=True)
class SkipChainField:
    """Log potentials: of a label given a token's features, and of the labels at both ends of a link."""

    token: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, nodes: Nodes, rounds: int = ROUNDS) -> np.ndarray:
        """Probability of each label at each node, by loopy sum-product with damping."""
        local = nodes.features @ self.token
        labels = local.shape[1]
        links = np.concatenate([nodes.chain, nodes.skip])
        weights = np.concatenate([
            np.broadcast_to(self.chain, (len(nodes.chain), labels, labels)),
            np.broadcast_to(self.skip, (len(nodes.skip), labels, labels)),
        ])
        source = np.concatenate([links[:, 0], links[:, 1]])
        target = np.concatenate([links[:, 1], links[:, 0]])
        weights = np.concatenate([weights, weights.transpose(0, 2, 1)])
        opposite = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
        messages = np.zeros((len(source), labels))
        for _ in range(rounds if len(source) else 0):
            belief = local.copy()
            np.add.at(belief, target, messages)
            sent = (belief[source] - messages[opposite])[:, :, None] + weights
            high = sent.max(axis=1, keepdims=True)
            new = np.log(np.exp(sent - high).sum(axis=1)) + high[:, 0]
            new -= new.max(axis=1, keepdims=True)
            messages = 0.5 * messages + 0.5 * new
        belief = local.copy()
        np.add.at(belief, target, messages)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)


def sample_nodes(text: str) -> Nodes:
    """The nodes of one sampled text, spans mentioned again included."""
    base = base_spans(text)
    longer, more = planted(text, base)
    return nodes_of([longer], [base + more], SAMPLE_NODES + 4 * PLANTS)


def joined_nodes(parts: list[Nodes]) -> Nodes:
    """Nodes of single documents as those of all."""
    if not parts:
        return nodes_of([], [])
    first = np.cumsum([0, *(len(p.doc) for p in parts)])
    return Nodes(
        np.concatenate([np.full(len(p.doc), d) for d, p in enumerate(parts)]),
        *(np.concatenate([getattr(p, f) for p in parts]) for f in ("start", "end", "features", "truth")),
        *(np.concatenate([getattr(p, f) + at for p, at in zip(parts, first, strict=False)]) for f in ("chain", "skip")),
    )


def fit_field(nodes: Nodes) -> SkipChainField:
    """Piecewise: the token part by gradient descent with an L2 penalty, each kind of link by counts of label pairs.

    What no pattern matches but a skip link ties to a match may well be personal data: it
    is neither taken for such nor for anything else, and left out.
    """
    labels = len(KINDS) + 1
    weights = np.zeros((_SHAPES, labels))
    weights[-1, 0] = 2.0
    known = np.ones(len(nodes.doc), bool)
    for one, other in (nodes.skip.T, nodes.skip.T[::-1]):
        known[one[(nodes.truth[one] == 0) & (nodes.truth[other] > 0)]] = False
    features, truth = nodes.features[known], nodes.truth[known]
    if len(truth):
        goal = np.eye(labels)[truth]
        for _ in range(300):
            score = features @ weights
            chance = np.exp(score - score.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            weights += 0.5 * (features.T @ (goal - chance) / len(goal) - 1e-4 * weights)
    share = np.bincount(truth, minlength=labels) + 1.0
    share /= share.sum()

    def ratios(links: np.ndarray, prior: np.ndarray) -> np.ndarray:
        counts = 20.0 * prior
        links = links[known[links].all(axis=1)]
        np.add.at(counts, (nodes.truth[links[:, 0]], nodes.truth[links[:, 1]]), 1.0)
        counts = (counts + counts.T) / (counts.sum() * 2)
        return np.log(counts / np.outer(share, share)).clip(-4, 4)

    independent = np.outer(share, share)
    alike = np.diag(share) * 0.95 + independent * 0.05
    return SkipChainField(weights, ratios(nodes.chain, independent), ratios(nodes.skip, alike))


def plausible(kind: int, body: str) -> bool:
    """Whether a labelled span can be what its label says."""
    digits = "".join(_DIGIT.findall(body))
    if KINDS[kind] == "email":
        return "@" in body
    if KINDS[kind] == "ip":
        parts = re.findall("[0-9]+", body)
        return len(parts) == 4 and all(map(small_part, parts))
    if KINDS[kind] == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def added_spans(texts: list[str], base: list[list[Span]], field: SkipChainField) -> list[list[Span]]:
    """Tokens outside all pattern spans with a label of at least CERTAIN, as far as they are plausible.

    Tokens of one label with nothing but white space and marks between them are one span.
    """
    nodes = nodes_of(texts, base)
    found: list[list[Span]] = [[] for _ in texts]
    if not len(nodes.doc):
        return found
    chance = field.marginals(nodes)
    label = chance.argmax(axis=1)
    sure = (label > 0) & (chance.max(axis=1) >= CERTAIN) & (nodes.truth == 0)
    for i in np.flatnonzero(sure):
        own, text = found[nodes.doc[i]], texts[nodes.doc[i]]
        token = text[nodes.start[i] : nodes.end[i]]
        body = token.strip(_EDGES)
        start = int(nodes.start[i]) + token.find(body)
        kind, end = int(label[i]) - 1, start + len(body)
        if own and own[-1][0] == kind and start - own[-1][2] <= 8 and not text[own[-1][2] : start].strip(_EDGES + " \t\r\n"):
            own[-1] = (kind, own[-1][1], end)
        else:
            own.append((kind, start, end))
    return [[s for s in own if plausible(s[0], text[s[1] : s[2]])] for own, text in zip(found, texts, strict=True)]


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _scan(field: SkipChainField):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, field)
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *counts,
                 pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b in base], pa.string()),
                 pa.array([_written(b + a) for b, a in zip(base, added, strict=True)], pa.string()),
                 pa.array([len(a) for a in added], pa.int64())],
                ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of sampled texts, as bytes; texts stay in the task."""
    for batch in batches:
        found = [sample_nodes(t) for t in batch.column("text").to_pylist()]
        columns = {
            "features": [np.packbits(n.features.astype(np.uint8)).tobytes() for n in found],
            **{f: [getattr(n, f).astype("<i4").tobytes() for n in found] for f in ("truth", "chain", "skip")},
        }
        yield pa.RecordBatch.from_arrays(
            [batch.column("lot"), *(pa.array(c, pa.binary()) for c in columns.values())], ["lot", *columns]
        )


def _unpacked(row) -> Nodes:
    truth, chain, skip = (np.frombuffer(row[f], "<i4").astype(np.int64) for f in ("truth", "chain", "skip"))
    bits = np.unpackbits(np.frombuffer(row["features"], np.uint8), count=len(truth) * _SHAPES)
    none = np.zeros(len(truth), np.int64)
    return Nodes(none, none, none, bits.reshape(-1, _SHAPES).astype(float), truth, chain.reshape(-1, 2), skip.reshape(-1, 2))


def fitted(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE_DOCS) -> SkipChainField:
    """The field of a table: from the texts with a digit or "@" whose hashes are least, in whole.

    Such texts are counted first and a share of them taken by hash, so that little more
    than the sample is looked at. Tasks make its nodes; some 10 MB of numbers come to the
    driver, however long the texts are.
    """
    rows = docs.select(
        uniform(F.col(key), F.col(text)).alias("lot"), whole(F.col(text)).alias("text")
    ).filter(F.regexp_like("text", F.lit("[0-9@]")))
    share = min(1.0, 1.5 * most / max(1, rows.count()))
    nodes = rows.filter(F.col("lot") <= share).mapInArrow(
        _sampled, "lot double, features binary, truth binary, chain binary, skip binary"
    )
    found = nodes.orderBy("lot", "features", "truth", "skip").limit(most).collect()
    return fit_field(joined_nodes([_unpacked(r) for r in found]))


def find_private_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and the digest are of the patterns' spans; ``spans`` has the field's as well.
    A null text is empty and has none; repeated rows give equal rows; no rows in, none
    out. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    field = fitted(docs, key, text)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return (
        docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
        .mapInArrow(_scan(field), f"key {kind}, {counts}, base_sha256 string, spans string, n_added long")
        .withColumnRenamed("key", key)
    )
