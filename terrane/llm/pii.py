"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

1. Candidates: matches of the base patterns (email, ip, card, phone) and of looser forms (obfuscated email, phone number in
   groups of three, three and four digits, which also finds one that a base match has run past, social security number, bank
   account number, person name).
2. Four labelers vote for, against or not at all: `form` (regex and check digits), `gazetteer` (known endings, number ranges,
   calling codes, names), `context` (words before the span) and `edges` (what touches the span).
3. Votes are counted over the corpus by (kind, votes), at most 9 * 81 rows, and expectation-maximisation on the counts gives the
   prior of each kind and how reliable each labeler is.
4. A logistic classifier of spans, on kind, votes, shape and hashed context, is fitted to the estimated labels of at most SAMPLE
   candidates (those with the smallest hashes), and judges every candidate.

Base spans that pass their own tests are always reported; other candidates are added where the classifier says so and they
overlap no base span. All passes over texts take whole texts; candidates, not texts, are written between the steps.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.staging import Staged

KINDS = ("email", "ip", "card", "phone", "obfuscated_email", "local_phone", "ssn", "iban", "name")
BASE_KINDS = 4
SAMPLE = 20_000
BUCKETS = 512
THRESHOLD = 0.9
PRIOR_SHARE = 0.005
VOTES = tuple(product((-1, 0, 1), repeat=4))
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
OBFUSCATED = re.compile(r"[A-Za-z0-9._-]{2,40} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{2,40} ?(?:\[dot\]|\(dot\)) ?[A-Za-z]{2,10}", re.ASCII)
LOCAL_PHONE = re.compile(r"(?<![0-9+-])(?:\+[0-9]{1,3} )?\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NAME = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?(?![A-Za-z])")
ENDINGS = frozenset("com org net edu gov info io co uk de fr es it nl eu ch at be se no dk pl pt br mx jp cn in ru us ca au".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 380 420 421 852 971 972".split())
NAMES = frozenset("james john robert michael william david mary linda susan anna maria laura peter paul hans klaus jean pierre marie jose juan carlos luis ana smith jones brown miller garcia lopez muller schmidt martin bernard".split())
CUES = {
    "email": "email mail e-mail contact write correo courriel".split(), "ip": "ip host server address addr login".split(),
    "card": "card visa mastercard credit pay payment tarjeta carte karte".split(), "phone": "phone tel call mobile fax cell telefon telefono".split(),
    "ssn": "ssn social security".split(), "iban": "iban account bank konto compte cuenta".split(), "name": "name signed dear regards author".split(),
}
AGAINST = frozenset("version isbn issn order invoice id ref page figure table chapter section line license rfc".split())
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_fits(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    last = 0
    while at >= 0:
        begin = max(end, last)
        begin += len(text[begin:at].rstrip(LOCAL))
        if begin < at and at >= end and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            end = m.end()
        last = at + 1
        at = text.find("@", last)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        if len(parts) < 4:
            continue
        edges = [m.start()]
        for p in parts:
            edges.append(edges[-1] + len(p) + 1)
        for i in range(0, len(parts) - 3, 4):
            yield edges[i], edges[i + 4] - 1


def base_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passes) of the base patterns: leftmost, non-overlapping per kind, by kind and start."""
    out = [(0, a, b, True) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for a, b in _ips(text):
            out.append((1, a, b, all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text[a:b].split("."))))
        for m in CARD.finditer(text):
            n = len(m.group()) if m.end() - m.start() < 16 else sum(c.isdigit() for c in m.group())
            if 16 <= n <= 19:
                digits = m.group().replace(" ", "").replace("-", "")
                out.append((2, m.start(), m.end(), len(digits) >= 16 and luhn(digits)))
        if "+" in text:
            out += [(3, m.start(), m.end(), 8 <= sum(map(str.isdigit, m.group())) <= 15) for m in PHONE.finditer(text)]
    return out


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    if DIGIT.search(text):
        out += [(5, m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)] if "-" in text or "." in text else []
        out += [(6, m.start(), m.end()) for m in SSN.finditer(text)] if "-" in text else []
        out += [(7, m.start(), m.end()) for m in IBAN.finditer(text)]
    if "at]" in text or "at)" in text:
        out += [(4, m.start(), m.end()) for m in OBFUSCATED.finditer(text)]
    if "Mr" in text or "Ms" in text or "Dr" in text or "Prof" in text:
        out += [(8, m.start(), m.end()) for m in NAME.finditer(text)]
    return out


def votes(text: str, kind: int, a: int, b: int, passes: bool) -> tuple[tuple[int, ...], list[str]]:
    """Votes of form, gazetteer, context and edges; words before and after."""
    name, span = KINDS[kind], text[a:b]
    digits = "".join(c for c in span if c.isdigit())
    before, after = WORD.findall(text[max(0, a - 48) : a].lower())[-4:], WORD.findall(text[b : b + 24].lower())[:1]
    form, known = 1 if passes else -1, 0
    if name in ("email", "obfuscated_email"):
        known = 1 if re.split(r"[^a-z]+", span.lower().rstrip(")] "))[-1] in ENDINGS else -1
    elif name == "ip":
        first = span.split(".")[0]
        known = -1 if first in ("0", "127") or len(first) > 3 else 1
    elif name == "card":
        known = 1 if digits[:1] == "4" or digits[:2] in ("34", "37", "51", "52", "53", "54", "55", "65") or digits[:4] == "6011" else 0
    elif name == "phone":
        known = 1 if any(digits[:k] in CALLING for k in (1, 2, 3)) else -1
    elif name == "local_phone":
        form, known = 0, 1 if digits[-10] not in "01" and digits[-7] not in "01" else -1
    elif name == "ssn":
        form = 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
    elif name == "iban":
        form = 1 if iban_fits(span) else -1
    elif name == "name":
        form, known = 0, 1 if any(w.lower() in NAMES for w in WORD.findall(span)[1:]) else 0
    cues = CUES.get({"obfuscated_email": "email", "local_phone": "phone"}.get(name, name), ())
    context = 1 if any(w in cues for w in before) else -1 if any(w in AGAINST for w in before) else 0
    left, right = text[a - 1 : a], text[b : b + 1]
    edges = -1 if left.isalnum() or right.isalnum() or left in ("/", "_", "=", "-") or right in ("/", "_", "=", "@") else 1
    return (form, known, context, edges), before[-2:] + ["_"] + after


def features(kind: int, pattern: int, span: str, words: list[str]) -> list[int]:
    """Eight bucket numbers: kind, four votes, shape, and the words around, hashed."""
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", span))))[:12]
    named = [f"k{kind}", f"p{pattern}", f"s{shape}", f"l{min(len(span), 40) // 4}", *[f"w{i}{w}" for i, w in enumerate(words)]]
    named += ["-"] * (8 - len(named))
    return [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=4).digest(), "little") % BUCKETS for x in named[:8]]


CANDIDATES = "doc_id long, kind array<int>, start array<long>, end array<long>, pattern array<int>, base array<boolean>, feats array<array<int>>"


def _scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.list_(pa.int32())))
    for batch in rows:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            cols: list[list] = [part.column(0).to_pylist(), [], [], [], [], [], []]
            for text in part.column(1).to_pylist():
                text = text or ""
                own = [(k, a, b, ok, ok) for k, a, b, ok in base_spans(text)] + [(k, a, b, True, False) for k, a, b in loose_spans(text)]
                marks = [votes(text, k, a, b, ok) for k, a, b, ok, _ in own]
                patterns = [VOTES.index(v) for v, _ in marks]
                for col, x in zip(cols[1:], ([o[0] for o in own], [o[1] for o in own], [o[2] for o in own], patterns, [o[4] for o in own], [features(o[0], p, text[o[1] : o[2]], m[1]) for o, p, m in zip(own, patterns, marks)])):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "kind", "start", "end", "pattern", "base", "feats"])


def label_model(counts: dict[tuple[int, int], int], rounds: int = 50) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """Priors by kind, P(vote | class) by (labeler, class, vote + 1), and the posterior of every (kind, pattern) seen.

    Whether a labeler votes at all says nothing about the class, only which way it does, and no labeler counts as worse than
    chance; else the two classes could come to mean two groups of kinds. A weak prior (PRIOR_SHARE of the votes) holds labelers
    that hardly ever vote.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kind, vote = np.array([k for k, _ in keys], int), np.array([VOTES[p] for _, p in keys], int).reshape(-1, 4)
    post = 1 / (1 + np.exp(-1.5 * vote.sum(1)))  # the start: a soft majority
    weight = 2 + PRIOR_SHARE * n.sum()
    silent = np.array([n[vote[:, i] == 0].sum() for i in range(4)]) / max(1.0, n.sum())
    prior, up = np.full(len(KINDS), 0.5), np.full((4, 2), 0.5)
    for _ in range(rounds if len(keys) else 0):
        for c, p in ((1, post), (0, 1 - post)):
            for i in range(4):
                yes, no = (float((n * p)[vote[:, i] == v].sum()) for v in (1, -1))
                share = (yes + weight * (0.75 if c else 0.25)) / (yes + no + weight)
                up[i, c] = max(0.5, share) if c else min(0.5, share)
        prior = (np.bincount(kind, weights=n * post, minlength=len(KINDS)) + 1) / (np.bincount(kind, weights=n, minlength=len(KINDS)) + 2)
        score = np.log(prior[kind] / (1 - prior[kind]))
        for i in range(4):
            score = score + np.where(vote[:, i] == 1, np.log(up[i, 1] / up[i, 0]), np.where(vote[:, i] == -1, np.log((1 - up[i, 1]) / (1 - up[i, 0])), 0.0))
        post = 1 / (1 + np.exp(-score))
    table = np.stack([(1 - up) * (1 - silent)[:, None], np.repeat(silent[:, None], 2, 1), up * (1 - silent)[:, None]], axis=2)
    return prior, table, dict(zip(keys, post.tolist()))


def fit_classifier(feats: np.ndarray, labels: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of the buckets, the last one the bias: logistic loss on soft labels, full-batch steps with decay."""
    w = np.zeros(BUCKETS + 1)
    if not len(feats):
        w[-1] = -10.0
        return w
    sq = np.full(BUCKETS + 1, 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(w[feats].sum(1) + w[-1])))
        g = np.zeros(BUCKETS + 1)
        np.add.at(g, feats.ravel(), np.repeat((p - labels) / len(labels), feats.shape[1]))
        g[-1] = (p - labels).mean()
        g += 1e-5 * w
        sq += g * g
        w -= 0.5 * g / np.sqrt(sq)
    return w


def _judge(rows: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out: list[list] = [[] for _ in range(7)]
        for x in batch.to_pylist():
            n, base, every = [0] * BASE_KINDS, [], []
            if x["kind"]:
                score = weights[np.array(x["feats"])].sum(1) + weights[-1]
                spans = sorted(zip(x["kind"], x["start"], x["end"], x["base"], (1 / (1 + np.exp(-score))).tolist()))
                taken = sorted((a, b) for _, a, b, ok, _ in spans if ok)
                begins, reach = np.array([a for a, _ in taken]), np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
                for k, a, b, ok, p in spans:
                    i = int(np.searchsorted(begins, b)) if taken else 0  # base spans that begin before this one ends
                    if ok:
                        n[k] += 1
                        base.append(f"{KINDS[k]}:{a}:{b}")
                    if ok or (k >= BASE_KINDS and p >= THRESHOLD and not (i and reach[i - 1] > a)):
                        every.append(f"{KINDS[k]}:{a}:{b}")
            for col, v in zip(out, (x["doc_id"], *n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(every))):
                col.append(v)
        types = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


class Detector:
    """The label model and the span classifier of a corpus; spans() applies them."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE):
        self.found = Staged(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan, CANDIDATES), "pii").df
        each = self.found.select("doc_id", F.explode(F.arrays_zip("kind", "start", "pattern", "feats")).alias("c"))
        each = each.select("doc_id", "c.kind", "c.start", "c.pattern", "c.feats")
        counts = {(r[0], r[1]): r[2] for r in each.groupBy("kind", "pattern").agg(F.count("*")).collect()}  # at most 9 * 81 rows
        self.prior, self.reliability, self.posterior = label_model(counts)
        drawn = F.xxhash64("doc_id", "kind", "start")
        share = min(1.0, 1.5 * sample / max(1, sum(counts.values())))  # about half as many again as needed, whatever the corpus holds
        some = each.filter(F.shiftrightunsigned(drawn, 11) < int(share * 2**53)).dropDuplicates(["doc_id", "kind", "start"])
        some = some.orderBy(drawn, "doc_id", "kind", "start").limit(sample).select("kind", "pattern", "feats").collect()
        feats = np.array([r[2] for r in some], int).reshape(len(some), 8)
        self.weights = fit_classifier(feats, np.array([self.posterior[r[0], r[1]] for r in some]))

    def spans(self) -> DataFrame:
        weights = self.weights
        schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
        return self.found.mapInArrow(lambda rows: _judge(rows, weights), schema)


def find_personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all of them, by kind and start).

    Null and empty texts have no spans; repeated rows are reported each; a corpus without candidates gives no extra spans; an
    empty table gives an empty one. Columns other than the two named are not read.
    """
    return Detector(docs, text, key).spans()
