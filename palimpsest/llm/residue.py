"""Template residue, filler, error pages and script notices instead of content.

A text is taken apart into units (lines, and sentences within them) with code and quotations
masked, since what is quoted or shown as code is talked about, not left over. A regularised
linear classifier with four classes (content, residue, error or notice, page furniture) reads
each unit through hashed word n-grams, word beginnings, length, place (title) and the share of
words that are common in the corpus. Nothing else decides: the phrases and response statuses
below only give weak labels to begin with. A unit beside a labelled one has no label at first;
it gets one from the classifier of the round before, as does a labelled unit whose document
turns out to hold content. A document is a case if a unit of it is residue, or if it holds an
error or notice and no content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTENT, RESIDUE, ERROR, FURNITURE, UNKNOWN = 0, 1, 2, 3, 4
DIMS = 1 << 18
SAMPLE_DOCS = 20_000  # documents that the classifier is fitted on and validated with, at most about so many
SAMPLE_CHARS = 30_000_000  # and about so many characters of text; a longer text than SAMPLE_TEXT is not sampled (all are judged)
SAMPLE_TEXT = 100_000
COMMON_SHARE = 0.004  # a word is common if it is in this share of the documents; so there are few common words
RESIDUE_FROM, ERROR_FROM, CONTENT_FROM = 0.5, 0.6, 0.9  # least probabilities of a unit that makes its document a case
HELD_OUT = 5  # one source in so many validates
ROUNDS = 3
SURE = 0.7  # probability from which the classifier's word goes before a weak label
BESIDE = 0.6  # weight of a label that a unit has from its neighbours
SHORT_PAGE = 8  # an error message of more units is taken for a part of something else at first
_BATCH_CHARS = 4_000_000
_KEPT_WORDS = 200_000
_BLOCK_UNITS = 20_000
_LONG = 5_000  # characters; a longer line without a sentence's end is read in parts

# fixed values: delimiters that mail, page and report templates put around a field's name
_NAME = r"[A-Za-z_][\w.\- |=?!]{0,60}"
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,80}\}\}|\$\{[^{}\n]{1,80}\}|\[\[[^\[\]\n]{1,80}\]\]|<<[^<>\n]{1,80}>>|<%=?[^%\n]{0,80}%>|\{%[^%\n]{0,80}%\}|\*\|[^|\n]{1,80}\|\*|%%[^%\n]{1,80}%%|@@[^@\n]{1,80}@@|__\w[^_\n]{0,60}(?:_[^_\n]{1,60})*__"
    rf"|%\([^()\n]{{1,80}}\)[sd]|\{{\d+\}}(?::{_NAME}(?=\s|[.,;:!?]|\Z))?|\{{\$?{_NAME}\}}|#\{{{_NAME}\}}|\$[A-Za-z_][\w.\- ]{{0,40}}\$|\[(?<![\w\]]\[){_NAME}\]|<(?<![\w`]<)(?!/?(?:div|p|h[1-6]|title|body|html|span|br|a|ul|li|main|nav|header|footer)\b){_NAME}>"
    r"|%(?<!\w%)[A-Za-z_]{3,40}%|#(?<!\w#)[A-Z_]{3,40}#|_{4,}"
)
# fixed values: phrases of the weak labels
FILLER = re.compile(
    r"\blorem\b|\bipsum\b|\b(?:text|title|description|summary|bio) (?:goes )?here\b|\b(?:coming soon|to follow)\b|\b(?:filler|dummy|placeholder) (?:text|copy)\b|\bblah? blah?\b|\basdf\b|\bqwert|\bfoo bar\b|\bx{3,} x{3,}|\btest(?:ing)? (?:test|\d)|\bsdfg\b|\byada yada\b|\b(?:sample|demo) (?:text|copy|paragraph)\b"
    r"|\b(?:type|write|put|add) (?:a|your|two|some) .{0,30}\b(?:here|about)\b|\b(?:paragraph|heading|bullet) (?:one|two|three)\b|\b(?:text|inhalt|bild) folgt\b|\bblindtext\b|\bhier .{0,30}(?:eingeben|einfügen)|\btexte (?:factice|à venir)|\b(?:votre|notre) \w+ ici\b|\btexto de relleno\b|\baquí tu\b|\bpróximamente\b"
)
ERRORS = re.compile(
    r"\bnot found\b|\baccess denied\b|\bforbidden\b|\bunavailable\b|\binternal server error\b|\bbad gateway\b|\btimed out\b|\bwent wrong\b|\b(?:session|link|token) (?:has )?expired\b|\bcould not (?:be|process|load)\b|\bcannot be (?:displayed|loaded|found)\b|\bdoes not exist\b|\btoo many requests\b|\btry again\b|\bunder maintenance\b"
    r"|\bnicht (?:gefunden|verfügbar|erreichbar|bearbeitet)\b|\bzugriff verweigert\b|\bgibt es nicht\b|\bkonnte (?:leider )?nicht\b|\bintrouvable\b|\baccès (?:interdit|refusé)\b|\bindisponible\b|\bn'a pas pu\b|\bn'est plus valide\b|\bno se (?:encuentra|encontró|pudo)\b|\bacceso denegado\b|\bno (?:está )?disponible\b|\bno existe\b"
    r"|\b(?:java ?script|js|scripts?|scripting|skripte)\b|\bfatal error\b|\bpermission (?:denied|refused)\b|\bcannot be read\b|\bsurchargé\b|\bsaturado\b|\bgewartet\b|\büberlastet\b"
)
STATUS = re.compile(r"(?i)^\W*(?:error|status|code|http(?:/[\d.]+)?|fehler|erreur)?\W*(?:4\d\d|5\d\d)\b")
NAVIGATION = re.compile(
    r"(?i)^\W*(?:(?:home|menu|back|help|docs|start|search|share|print|save|contact|privacy|terms|imprint|cookies?|sign in|log ?in|skip to content|language|en|de|fr|es|inicio|accueil|hilfe|view|all rights reserved)[\s|>\-:,.()\[\]/]*)+$|^\(c\) .{0,40}$|^©.{0,40}$|^v\d[\d.]* build \d+$|^\W*at [\w.$]+ \([\w.]+:\d+\)$|^\W*(?:ref|request id|incident|trace id)\W*[0-9a-f]+$"
)
# fixed values: general words of explaining, quoting and reporting
EXPLAINS = re.compile(
    r"\b(?:examples?|snippets?|syntax|such as|like|called|written|escaped|stripped|expanded|replaced|removed|deprecated|braces|strings?|guides?|manuals?|docs|reported|counted|logged|rose|fell|bugs?|issues?|typo|says?|said|sagte?|laut|dit|selon|dice|dijo|según|beispiel|exemple|ejemplo)\b"
)
_TITLE = re.compile(r"(?is)<title>.*?</title>")
_TAG = re.compile(r"(?i)</?(?:div|p|h[1-6]|body|html|span|br|a|ul|li|main|nav|header|footer)(?: [^<>]*)?/?>")
_BLANKS = re.compile(r"[^\S\n\r]+")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_SPAN = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r"\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|„[^“\n]{1,200}“|«[^»\n]{1,200}»")
_LINE = re.compile(r"[^\n\r]+")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_+")
FIELD, MASKS = " phfield ", ("codespan", "codeblock", "quotedspan")


def units(text: str) -> list[str]:
    """Lines and the sentences in them; code, quotations and template fields as one word each, odd blanks as plain ones."""
    text = _BLANKS.sub(" ", _INVISIBLE.sub("", text))
    if "`" in text:
        text = _SPAN.sub(" codespan ", _FENCE.sub("\ncodeblock\n", text))
    text = _QUOTED.sub(" quotedspan ", text)
    if "<" in text:
        text = _TAG.sub(" ", _TITLE.sub("\nmenu\n", text))
    text = PLACEHOLDER.sub(FIELD, text)
    found = [s.strip() for line in _LINE.findall(text) for s in _SENTENCE.split(line) if s.strip()]
    if max(map(len, found), default=0) > _LONG:
        found = [p for s in found for i in range(0, len(s), _LONG) if (p := s[i : i + _LONG].strip())]
    return found


def tokenise(unit: str) -> list[str]:
    """Lower-case words, marks and numbers."""
    return _TOKEN.findall(unit.lower())


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        return x ^ (x >> np.uint64(29))


def _word_hash(w: str) -> int:
    return xxhash.xxh64_intdigest(w)


_ANY, _NUMBER, _STATUS = _word_hash("*"), _word_hash("#"), _word_hash("#status")


class _Words(dict):
    """Numbers of words; what is asked for the first time is hashed and numbered."""

    def __init__(self, common: frozenset[str]) -> None:
        super().__init__()
        self.common, self.table = common, []

    def __missing__(self, w: str) -> int:
        letters = w[0].isalpha()
        h = _word_hash(w) if not w[0].isdigit() else _STATUS if len(w) == 3 and w[0] in "45" and w[1] in "0123" else _NUMBER
        shown = h if not letters or w in self.common else _ANY
        self.table.append((h, shown, _word_hash(w[:5] + "~") if letters and len(w) > 5 else 0, letters, w in self.common))
        self[w] = n = len(self.table) - 1
        return n


class Reader:
    """Hashed features of whole batches of documents. Words are looked up once and kept, up to some number."""

    def __init__(self, common: frozenset[str]) -> None:
        self.common, self.words = common, _Words(common)

    def read(self, docs: list[list[str]]) -> Features:
        """Features of the units of `docs`, in order."""
        parts, lo = [], 0
        while lo < len(docs) or not parts:
            hi, n = lo, 0
            while hi < len(docs) and (hi == lo or n + len(docs[hi]) <= _BLOCK_UNITS):
                n += len(docs[hi])
                hi += 1
            some = docs[lo:hi]
            of, place = (np.array([x for found in some for x in y(found)], np.int64) for y in (lambda d: [len(d)] * len(d), lambda d: range(len(d))))
            parts.append(self.features([u for found in some for u in found], of, place))
            lo = max(hi, lo + 1)
        begins = np.cumsum([0, *[len(f.norm) for f in parts]])[:-1].astype(np.int32)
        join = lambda get: np.concatenate([get(f) for f in parts])
        return Features(np.concatenate([f.unit + b for f, b in zip(parts, begins)]), join(lambda f: f.code), join(lambda f: f.norm), join(lambda f: f.words), join(lambda f: f.shown))

    def features(self, found: list[str], of: np.ndarray, place: np.ndarray) -> Features:
        """Features of units, which are at such places of documents of so many units."""
        if len(self.words) > _KEPT_WORDS:
            self.words = _Words(self.common)
        ids, lens, number, n = [], [], self.words.__getitem__, len(found)
        for u in found:
            t = tokenise(u)
            ids.extend(map(number, t))
            lens.append(len(t))
        ends, upper = np.array([u[-1] in ".!?;" for u in found], np.int64), np.array([u.isupper() for u in found], np.int64)
        quoted = np.array([any(m in u for m in MASKS) for u in found], bool)
        lens = np.array(lens, np.int64)
        cols = list(zip(*self.words.table)) if self.words else [()] * 5
        table = [np.array(c, k) for c, k in zip(cols, (np.uint64, np.uint64, np.uint64, bool, bool))]
        at = np.array(ids, np.int64)
        unit = np.repeat(np.arange(n), lens)
        h, shown, head = (table[i][at] for i in range(3)) if len(at) else (np.empty(0, np.uint64),) * 3
        letters = table[3][at] if len(at) else np.empty(0, bool)
        words = np.bincount(unit[letters], minlength=n)
        shares = np.bincount(unit[letters], table[4][at][letters].astype(float) if len(at) else None, minlength=n) / np.maximum(words, 1)
        two = np.nonzero(unit[1:] == unit[:-1])[0]
        three = np.nonzero(unit[2:] == unit[:-2])[0]
        k = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
        with np.errstate(over="ignore"):
            first = np.nonzero(np.diff(unit, prepend=-1))[0]
            title = first[place[unit[first]] == 0]
            parts = [
                (unit, h), (unit[two], _mixed(h[two] * k[0] + h[two + 1])), (unit[three], _mixed(_mixed(h[three] * k[0] + h[three + 1]) * k[1] + h[three + 2])),
                (unit[two], _mixed(shown[two] * k[2] + shown[two + 1])), (unit[head > 0], head[head > 0]), (unit[title], h[title] * k[3]),
            ]
            every = np.arange(n)
            for i, x in enumerate((np.minimum(lens, 40) // 4, np.minimum(of, 12), np.where(words, (shares * 8).astype(np.int64), 9), upper, ends * 2 + (place == 0))):
                parts.append((every, _mixed(x.astype(np.uint64) * k[3] + np.uint64(1000 + i))))
        owner, code = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        code = (_mixed(code) % np.uint64(DIMS)).astype(np.int32)
        return Features(owner.astype(np.int32), code, np.sqrt(np.bincount(owner, minlength=n)), words, quoted)


@dataclass
class Features:
    unit: np.ndarray
    code: np.ndarray
    norm: np.ndarray  # per unit
    words: np.ndarray  # per unit
    shown: np.ndarray  # per unit: whether code or a quotation is in it

    def chosen(self, keep: np.ndarray) -> Features:
        """The units where `keep`, numbered anew and in order."""
        number = (np.cumsum(keep) - 1).astype(np.int32)
        on = keep[self.unit]
        unit, code = number[self.unit[on]], self.code[on]
        order = np.argsort(unit, kind="stable")
        return Features(unit[order], code[order], self.norm[keep], self.words[keep], self.shown[keep])

    def followed(self, other: Features) -> Features:
        pairs = ((self.unit, other.unit + np.int32(len(self.norm))), (self.code, other.code), (self.norm, other.norm), (self.words, other.words), (self.shown, other.shown))
        return Features(*map(np.concatenate, pairs))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


@dataclass
class Model:
    weights: np.ndarray  # (DIMS + 1, 4), float32
    common: frozenset[str]
    held_out: dict[str, float] = field(default_factory=dict)

    def probabilities(self, f: Features) -> np.ndarray:
        n = len(f.norm)
        z = np.empty((n, 4))
        for c in range(4):
            z[:, c] = np.bincount(f.unit, self.weights[f.code, c], n)
        return _softmax(z / np.maximum(f.norm, 1)[:, None] + self.weights[DIMS])

    def judge(self, docs: list[list[str]], reader: Reader) -> list[str]:
        """Per document `residue`, `error` or nothing."""
        found, sizes = [u for d in docs for u in d], np.array([len(d) for d in docs], np.int64)
        of, place = np.repeat(sizes, sizes), np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        p, words, shown = [np.empty((0, 4))], [np.empty(0, np.int64)], [np.empty(0, bool)]
        for lo in range(0, len(found), _BLOCK_UNITS):
            part = slice(lo, lo + _BLOCK_UNITS)
            f = reader.features(found[part], of[part], place[part])
            p.append(self.probabilities(f))
            words.append(f.words)
            shown.append(f.shown)
        return verdicts(np.concatenate(p), np.concatenate(words), np.concatenate(shown), sizes)


def verdicts(p: np.ndarray, words: np.ndarray, shown: np.ndarray, sizes: np.ndarray) -> list[str]:
    """What documents of so many units are, by their units' class probabilities. A unit of up to three words is too short to be content, unless it shows code or quotes."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    has = lambda on: np.bincount(doc[on], minlength=len(sizes)) > 0
    residue, error, content = has(p[:, RESIDUE] > RESIDUE_FROM), has(p[:, ERROR] > ERROR_FROM), has((p[:, CONTENT] > CONTENT_FROM) & (words > 3) | shown)
    return ["residue" if r else "error" if e and not c else "" for r, e, c in zip(residue, error, content)]


def fit(f: Features, y: np.ndarray, weight: np.ndarray, common: frozenset[str], l2: float = 1e-6, epochs: int = 14, batch: int = 1024, rate: float = 2.0, seed: int = 3) -> Model:
    """Softmax regression with an L2 penalty, by AdaGrad over shuffled batches. Units of `f` are in order."""
    n = len(y)
    used, code = np.unique(f.code, return_inverse=True)
    w, seen = np.zeros((len(used) + 1, 4), np.float32), np.full(len(used) + 1, 1e-4, np.float32)
    begin = np.searchsorted(f.unit, np.arange(n + 1))
    rng, scale = np.random.default_rng(seed), (1 / np.maximum(f.norm, 1)).astype(np.float32)[:, None]
    target, weight = np.eye(4, dtype=np.float32)[y], (weight / (weight.mean() if n else 1)).astype(np.float32)[:, None]
    mean, late = np.zeros_like(w), max(1, epochs // 4)  # the model is the mean of the last epochs' ends
    for epoch in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            b = order[lo : lo + batch]
            count = begin[b + 1] - begin[b]
            first = np.cumsum(count) - count
            at = code[np.arange(count.sum()) + np.repeat(begin[b] - first, count)]
            z = np.add.reduceat(w[at], first, axis=0) * scale[b] + w[-1]
            g = (_softmax(z) - target[b]) * weight[b] / len(b)
            of = np.repeat(g * scale[b], count, axis=0)
            here, at = np.unique(at, return_inverse=True)
            grad = np.stack([np.bincount(at, of[:, c], len(here)) for c in range(4)], 1) + l2 * w[here]
            seen[here] += (grad**2).max(1)
            w[here] -= rate * grad / np.sqrt(seen[here])[:, None]
            bias = g.sum(0)
            seen[-1] += (bias**2).max()
            w[-1] -= 0.1 * rate * bias / np.sqrt(seen[-1])
        if epoch >= epochs - late:
            mean += w / late
    full = np.zeros((DIMS + 1, 4), np.float32)
    full[used], full[DIMS] = mean[:-1], mean[-1]
    return Model(full, common)


def weak_labels(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A class for each unit of a document by phrases and statuses, and which units have theirs only from their neighbours.

    What stands beside an error message on a short page is taken for a part of it; in a longer text the message is talked
    about. Beside residue a unit is UNKNOWN; a document without any phrase is content.
    """
    y = np.full(len(found), UNKNOWN, np.int8)
    for i, u in enumerate(map(str.lower, found)):
        if NAVIGATION.match(u):
            y[i] = FURNITURE
        elif any(m in u for m in MASKS):
            y[i] = CONTENT  # what is shown as code or quoted is talked about
        elif "phfield" in u or FILLER.search(u):
            y[i] = CONTENT if EXPLAINS.search(u) else RESIDUE
        elif ERRORS.search(u) or STATUS.match(u):
            y[i] = CONTENT if EXPLAINS.search(u) else ERROR
    beside = y == UNKNOWN
    if (y == ERROR).any() and not (y == RESIDUE).any():
        page = (y == ERROR).sum() + beside.sum() <= SHORT_PAGE
        y[beside if page else y == ERROR] = ERROR if page else CONTENT
    elif not (y == RESIDUE).any():
        y[beside] = CONTENT
    return y, beside


def relabelled(y: np.ndarray, beside: np.ndarray, p: np.ndarray, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Labels for the next round: units without a phrase of their own are judged by the model, and a message beside content is content that talks of it."""
    n = int(doc.max()) + 1 if len(doc) else 0
    kind = p.argmax(1)
    # a few words of a text without any phrase say too little to go against it
    plain = beside & (y == CONTENT)
    open_ = beside & ~(plain & (words <= 3))
    out = np.where((y == UNKNOWN) | (open_ & (p.max(1) > SURE)), kind, y)
    content = (np.bincount(doc[beside & (p[:, CONTENT] > 0.95) & (words > 3)], minlength=n) > 0)[doc]
    out = np.where((out == ERROR) & content, CONTENT, out)
    out = np.where(plain & open_ & (out == CONTENT) & (p[:, CONTENT] < SURE), UNKNOWN, out)  # nobody knows
    return np.where((y == ERROR) & ~beside & (p[:, CONTENT] > 0.5), CONTENT, out).astype(np.int8)


@dataclass
class Sample:
    """Documents as units, their hosts, features and weak labels."""

    docs: list[list[str]]
    held: np.ndarray  # per document
    features: Features
    blind: Features  # of the labelled units without the phrases that label them
    of: np.ndarray  # the units that `blind` stands for
    labels: np.ndarray
    beside: np.ndarray
    doc: np.ndarray  # per unit


def sampled(texts: list[str], hosts: list[str], common: frozenset[str]) -> Sample:
    docs = [units(t) for t in texts]
    kinds = sorted(set(hosts))
    out = {h for h in kinds if xxhash.xxh32_intdigest(h) % HELD_OUT == 0}
    if len(kinds) > 1 and not 0 < len(out) < len(kinds):
        out = {min(kinds, key=xxhash.xxh32_intdigest)}  # some host validates wherever there are two
    elif len(kinds) < 2:
        out = set()
    every = [u for found in docs for u in found]
    told = [(np.empty(0, np.int8), np.empty(0, bool)), *map(weak_labels, docs)]
    labels, beside = (np.concatenate([t[i] for t in told]) for i in (0, 1))
    of = [i for i in np.nonzero(~beside & ((labels == RESIDUE) | (labels == ERROR)))[0] if "phfield" not in every[i]]
    masked = [(i, m.strip()) for i in of if (m := ERRORS.sub(" ", FILLER.sub(" ", every[i].lower()))) != every[i].lower()]
    masked = [(i, m) for i, m in masked if len(tokenise(m)) > 3]
    reader = Reader(common)
    blind = reader.read([[m] for _, m in masked])
    return Sample(docs, np.array([h in out for h in hosts], bool), reader.read(docs), blind, np.array([i for i, _ in masked], np.int64), labels, beside, np.repeat(np.arange(len(docs)), [len(u) for u in docs]))


def learn(s: Sample, common: frozenset[str], rounds: int = ROUNDS) -> Model:
    """Fit on the documents of hosts that are not held out.

    Before that, so many times, each half of them is judged by a model of the other half, and its units get their
    labels from that where the weak labels leave it open.
    """
    odd = np.bincount(s.doc[s.labels != CONTENT], minlength=len(s.docs))[s.doc] > 0
    few = np.bincount(s.doc, minlength=len(s.docs))[s.doc] <= 3
    some = np.random.default_rng(5).random(len(s.labels)) < 0.15  # of plain content in longer texts, a part of the units is enough
    use, half = ~s.held[s.doc] & (odd | some | few), s.doc % 2
    # of a label by neighbours little is taken
    soft = np.where(s.beside & (s.labels != CONTENT), BESIDE, 1.0)

    def fitted(y: np.ndarray, on: np.ndarray) -> Model | None:
        keep = on & (y != UNKNOWN)
        too = keep[s.of]
        at = np.concatenate([y[keep], y[s.of][too]])
        share = np.bincount(at, minlength=4) + 1.0
        weight = np.sqrt(share.sum() / share)[at] * np.concatenate([soft[keep], np.ones(too.sum())])
        return fit(s.features.chosen(keep).followed(s.blind.chosen(too)), at, weight, common)

    y = s.labels
    for _ in range(rounds):
        p = np.empty((len(y), 4))
        for side in (0, 1):
            p[half == side] = fitted(y, use & (half != side)).probabilities(s.features)[half == side]
        y = relabelled(s.labels, s.beside, p, s.features.words, s.doc)
    return fitted(y, use)


def validate(s: Sample, model: Model) -> dict[str, float]:
    """The held-out documents' cases by the weak labels alone and by the classifier alone, and how many only one of them has."""
    sizes, f = np.array([len(u) for u in s.docs], np.int64), s.features
    first = np.where(s.labels == UNKNOWN, CONTENT, s.labels)
    said = np.array([x != "" for x in verdicts(model.probabilities(f), f.words, f.shown, sizes)], bool)[s.held]
    told = np.array([x != "" for x in verdicts(np.eye(4)[first], f.words, f.shown, sizes)], bool)[s.held]
    both = int((said & told).sum())
    return {"documents": int(s.held.sum()), "both": both, "model_only": int(said.sum()) - both, "labels_only": int(told.sum()) - both}


def train(documents: DataFrame) -> Model | None:
    """Fit on a sample of at most about SAMPLE_DOCS documents and SAMPLE_CHARS characters; common words are counted over all.

    The driver gets the sample and the common words, of which there are at most the average number of
    different words per document over COMMON_SHARE. None without any text. With a single host, nothing is held out.
    """
    texts = documents.select("doc_id", "text", "source").where("trim(text) <> ''")
    n, size = texts.agg(F.count("*"), F.sum(F.length("text").cast("double"))).first()
    if not n:
        return None
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    common = frozenset(r["w"] for r in words.where(F.col("n") >= max(2, n * COMMON_SHARE)).collect())
    bound = min(1 << 30, int((1 << 30) * min(SAMPLE_DOCS / n, SAMPLE_CHARS / size)))
    some = texts.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bound) & (F.length("text") <= SAMPLE_TEXT))
    some = some.select("doc_id", "text", F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("host")).toArrow().sort_by([("doc_id", "ascending"), ("host", "ascending")])
    s = sampled(some["text"].to_pylist(), some["host"].to_pylist(), common)
    model = learn(s, common)
    model.held_out = validate(s, model)
    return model


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        reader = Reader(m.common)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            lo = 0
            while lo < len(ids):
                docs, chars, hi = [], 0, lo
                while hi < len(ids) and (hi == lo or chars + len(texts[hi].as_py()) < _BATCH_CHARS):
                    docs.append(units(t := texts[hi].as_py()))
                    chars += len(t)
                    hi += 1
                kinds = m.judge(docs, reader)
                at = [i for i, k in enumerate(kinds) if k]
                yield pa.RecordBatch.from_arrays([pa.array([ids[lo + i].as_py() for i in at], pa.int64()), pa.array([kinds[i] for i in at], pa.string())], names=["doc_id", "kind"])
                lo = hi

    return score


def residue(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, kind) of the documents that are residue or filler (`residue`), or an error or notice as a whole (`error`).

    Null, empty and blank texts are no cases; repeated rows count once; whole texts are read, whatever their length;
    null sources are one host; extra columns are ignored.
    """
    spark = documents.sparkSession
    model = model or train(documents)
    texts = documents.select("doc_id", "text").where("trim(text) <> ''")
    if model is None:
        return texts.select("doc_id", F.lit("").alias("kind")).where("false")
    shared = spark.sparkContext.broadcast(model)  # DIMS weights and the common words: a fixed size
    return texts.mapInArrow(_scorer(shared), "doc_id long, kind string").distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents, all columns, that are no case."""
    cases = residue(documents).select(F.col("doc_id").alias("_case")).distinct()
    return documents.join(cases, F.col("doc_id") == F.col("_case"), "left_anti")
