"""Personal data: rules for well-formed data, and a skip-chain conditional random field for the rest.

Base spans (email, ip, card, phone) come from patterns and checks. The field labels what no pattern decides: long tokens with digits or mixed case
(`secret`: access tokens, passwords, keys; `account`: account, customer and document numbers) and runs of capitalised words (`name`), or nothing. Its
graph has these candidates and the base spans (whose label is given) as nodes. Neighbours are joined by chain potentials. Repeats of one token, tokens
alike (same shape and beginning), and a name and an e-mail address that holds it are joined by skip potentials, wherever they stand in the
document, so that one mention after a telling word speaks for all others. What a token looks like counts once, at its first mention; further mentions add
what stands around them and nothing else, and repeat potentials only say how strongly mentions agree, so a mention that nothing tells of has nothing to say,
however often it comes. Loopy sum-product messages are passed over the whole document's
graph until they settle. All other words can only be nothing, which cuts the chain there; so the graph's edges are linear in its nodes (repeats
are linked to their first mention).
Weights are fitted in the driver by pseudo-likelihood, on documents that this module makes up from templates, with as many tokens of the same shapes after
words that tell of something else (orders, checksums, versions) or after none; nothing of the corpus is learned from.

Defined results: null and empty texts have no spans; rows that share a doc_id (or have none) are looked at each for itself, repeated rows alike; base spans
always stay, and the field adds spans of its own kinds only where no base span is; an empty table gives no rows; other columns are ignored, whatever
their names; very long texts are looked at as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
LABELS = ("", "secret", "account", "name", "base")
NOTHING, SECRET, ACCOUNT, NAME, GIVEN = range(5)
KINDS = (*BASE, *LABELS[1:GIVEN])

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins where a run of digits begins and takes it whole, so nothing is looked at twice
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
TOKEN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{8,}+")
CAPITALS = re.compile(r"\b[A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})+\b")
WORD = re.compile(r"[^\W\d_]+")
LETTERS = re.compile(r"[A-Za-z]{3,}")
DATE = re.compile(r"(?:19|20)\d\d[-/]\d\d?[-/]\d\d?|\d\d?[-/]\d\d?[-/](?:19|20)\d\d|(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:[0-2]\d|3[01])")
#: Where what tells of a candidate ends: at a sentence's end, and at the number before.
CUT = re.compile(r"[.!?;\n]\s|[0-9]{4,}")
#: Beginnings of access tokens that are public knowledge; capitalised words that are no one's name (fixed values).
PREFIX = re.compile(r"gh[opsur]_|github_pat_|glpat-|sk_live_|sk_test_|sk-|pk_live_|rk_live_|xox[abprs]-|AKIA|ASIA|AIza|eyJ|hf_|npm_|pypi-|dop_v1_|SG\.")
NO_NAMES = frozenset("sir madam thank thanks you us we our all the this that today tomorrow yesterday new great good best kind hello hi welcome please click read more about home page terms privacy monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december street avenue road city county river lake island mountain wall north south east west saint university college school bank company inc ltd corp los las san angeles york united states kingdom".split())
#: Words around a candidate that the field may learn from: of secrets, of accounts, of persons, of other things (fixed values).
CUES = {
    SECRET: "token secret password passwort contraseña passwd pwd api key credential bearer auth authorization private signing passphrase login",
    ACCOUNT: "account konto compte cuenta iban customer client kunde cliente member passport license licence driver insurance policy ssn social security tax patient employee",
    NAME: "mr mrs ms dr prof herr frau señor señora monsieur madame name named called dear sincerely regards signed contact attn",
    NOTHING: "order invoice commit hash checksum sha md5 page section part model version build revision isbn serial ticket case flight tracking shipped item article chapter line port size file image release batch figure city street company university river",
}
VOCABULARY = {w: i for i, w in enumerate(w for words in CUES.values() for w in words.split())}
SHAPES = 18
ALONE = 2 + 15  # the flag of a candidate that no mention's surroundings tell of
FEATURES = SHAPES + 2 * len(VOCABULARY)
CONTEXT, NEAR = 40, 24
#: Messages are passed until none changes by more; rounds besides those that the graph needs (see messages).
SETTLED, LEAST_ROUNDS = 1e-4, 50


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of well-formed data, by start and kind."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        done = at  # what stands before can't belong to a later match
        if start < at and (m := DOMAIN.match(text, at)):
            done = m.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(len, DIGITS.findall(m[0]))) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Node(NamedTuple):
    start: int
    end: int
    base: int  # kind of a base span, or -1
    name: bool


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> list[Node]:
    """Base spans and candidates that overlap none, in order of place."""
    out = []
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] in "-/+_":  # separators at the ends belong to the sentence
            end -= 1
        while start < end and text[start] in "-/+_":
            start += 1
        token = text[start:end]
        if end - start >= 8 and (any(c.isdigit() for c in token) or end - start >= 16 and not token.islower() and not token.isupper()):
            out.append(Node(start, end, -1, False))
    for m in CAPITALS.finditer(text):
        words, start = m[0].split(" "), m.start()
        while words and words[0].lower() in VOCABULARY:  # a title or greeting tells of the name but isn't part of it
            start += len(words.pop(0)) + 1
        if 2 <= len(words) == len(set(words)) <= 3 and not any(w.lower() in NO_NAMES for w in words):
            out.append(Node(start, m.end(), -1, True))
    out.sort()
    kept, upto, k = [], 0, 0
    for node in out:
        while k < len(base) and base[k][2] <= node.start:
            k += 1
        if node.start >= upto and not any(a < node.end and b > node.start for a, _, b in base[k : k + 4]):
            kept.append(node)
            upto = node.end
    return sorted(kept + [Node(a, b, kind, False) for a, kind, b in base])


def around(text: str, node: Node) -> list[int]:
    """Numbers of the features that a mention's surroundings give: telling words, and an equals sign or colon before it."""
    before, after = text[max(0, node.start - CONTEXT) : node.start], text[node.end : node.end + CONTEXT]
    sentence = CUT.split(before)[-1]
    near = [VOCABULARY[w] for w in WORD.findall(sentence.lower())[-2 if node.name else -4 :] if w in VOCABULARY]
    behind = [VOCABULARY[w] for w in WORD.findall(CUT.split(after)[0].lower())[:2] if w in VOCABULARY]
    out = [SHAPES + i for i in set(near)] + [SHAPES + len(VOCABULARY) + i for i in set(behind)]
    return out if node.name or not sentence.rstrip(" \"'`").endswith(("=", ":")) else [*out, 2]


def shape(token: str, name: bool) -> list[int]:
    """Numbers of the features of a token itself."""
    if name:
        return [0, 1]
    n, digits = len(token), sum(c.isdigit() for c in token)
    upper, lower = any(c.isupper() for c in token), any(c.islower() for c in token)
    changes = sum(x.isupper() != y.isupper() or x.isdigit() != y.isdigit() for x, y in zip(token, token[1:], strict=False)) / n
    flags = (digits == n, 0 < digits < n and not upper, upper and lower and digits > 0, upper and lower and not digits, changes > 0.3, n >= 16, n >= 24, n >= 36, n > 80,
             all(c in "0123456789abcdef" for c in token) and digits < n, bool(DATE.fullmatch(token)), "-" in token or "_" in token, bool(PREFIX.match(token)) and n >= 16, len(set(token)) >= 16)
    return [0] + [3 + i for i, flag in enumerate(flags) if flag]


def features(text: str, nodes: list[Node]) -> list[list[int]]:
    """Each candidate's features: its shape at its first mention alone, its surroundings at every mention. Base spans have none."""
    out, first, told = [], {}, set()
    for i, node in enumerate(nodes):
        if node.base >= 0:
            out.append([])
            continue
        token, own = text[node.start : node.end], around(text, node)
        key = token.lower()
        if any(x >= SHAPES for x in own):
            told.add(key)
        if key not in first:
            first[key] = i
            own = shape(token, node.name) + own
        out.append(own)
    for key, i in first.items():
        if key not in told:
            out[i].append(ALONE)
    return out


CHAIN, REPEAT, ALIKE = range(3)


def edges(text: str, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes, and their kinds: neighbours; repeats, each with the first mention; first mentions that are alike, each with the next."""
    pairs, kinds, first, alike = [], [], {}, {}
    for i, node in enumerate(nodes):
        if i and node.start - nodes[i - 1].end <= NEAR:
            pairs.append((i - 1, i))
            kinds.append(CHAIN)
        token = text[node.start : node.end].lower()
        if token in first:
            pairs.append((first[token], i))
            kinds.append(REPEAT)
            continue
        first[token] = i
        if node.base >= 0:
            keys = [part for part in LETTERS.findall(token.split("@")[0])] if node.base == 0 else []
        else:
            keys = token.split() if node.name else [(token[:4], len(token))]
        for key in dict.fromkeys(keys):
            if key in alike and alike[key] != i:
                pairs.append((alike[key], i))
                kinds.append(ALIKE)
            alike[key] = i
    return np.array(pairs, np.int64).reshape(-1, 2), np.array(kinds, np.int64)


def messages(unary: np.ndarray, pairs: np.ndarray, coupling: np.ndarray) -> np.ndarray:
    """Marginals by loopy sum-product, passed until the messages settle; coupling[e] holds the log potentials of edge e.

    News travels one edge a round and is damped by half, so there are four rounds for each node at most, and LEAST_ROUNDS more.
    """
    sent = np.zeros((2 * len(pairs), unary.shape[1]))
    if len(pairs):
        a, b = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])  # each edge in both directions
        both = np.exp(np.concatenate([coupling, coupling.transpose(0, 2, 1)]))
        back = np.roll(np.arange(len(a)), len(pairs))
        for _ in range(LEAST_ROUNDS + 4 * len(unary)):
            held = (unary + gathered(sent, b, len(unary)))[a] - sent[back]
            held = np.exp(held - held.max(1, keepdims=True))
            new = np.log(np.einsum("ei,eij->ej", held, both))
            new -= new.mean(1, keepdims=True)
            change = np.abs(new - sent).max()
            sent = 0.5 * sent + 0.5 * new
            if change < SETTLED:
                break
        unary = unary + gathered(sent, b, len(unary))
    out = np.exp(unary - unary.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def gathered(sent: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Sum of the messages that each node gets."""
    return np.stack([np.bincount(to, sent[:, j], n) for j in range(sent.shape[1])], 1)


class Maker:
    """Documents with labelled candidates, made up from templates."""

    TEMPLATES = {  # fixed values: {} stands for the candidate, cue for a telling word
        SECRET: ("cue = {}", "cue: {}", 'the cue is "{}"', "use the cue {} to sign in", "my cue is {}", "cue {}"),
        ACCOUNT: ("cue number {}", "cue {}", "the cue {} is closed", "cue no {}", "cue: {}", "paid from cue {}"),
        NAME: ("cue {}", "my cue is {}", "cue, {}", "cue: {}"),
        NOTHING: ("cue {}", "cue number {}", "cue: {}", "the cue {} is here", "see cue {}", "cue = {}"),
    }
    CASED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def drawn(self, letters: str, n: int) -> str:
        return "".join(self.rng.choice(list(letters), n))

    def one(self, *makers):
        return makers[int(self.rng.integers(len(makers)))]()

    def between(self, a: int, b: int) -> int:
        return int(self.rng.integers(a, b))

    def word(self) -> str:
        return "".join(self.drawn("bcdfglmnprst", 1) + self.drawn("aeiou", 1) for _ in range(self.between(1, 4)))

    def hexadecimal(self) -> str:
        return self.drawn("0123456789abcdef", int(self.rng.choice([16, 24, 32, 40, 40, 64])))

    def digits(self) -> str:
        return self.drawn("0123456789", self.between(8, 19))

    def grouped(self) -> str:
        return "-".join(self.drawn("0123456789", 4) for _ in range(self.between(2, 4)))

    def mixed(self) -> str:
        return self.drawn(self.CASED + "0123456789" * 2, self.between(12, 44))

    def password(self) -> str:
        return (self.word() + self.word())[:8] + self.drawn("0123456789", self.between(1, 4)) + self.word() + self.word() + self.drawn("0123456789", self.between(0, 3))

    def token(self, label: int) -> str:
        """Each label's shapes; but for mixed case they are shared, so the words around decide."""
        if label == SECRET:
            return self.one(self.hexadecimal, self.hexadecimal, self.mixed, self.password, self.password, lambda: self.drawn(self.CASED, self.between(18, 32)), lambda: self.drawn("abcdefghijklmnopqrstuvwxyz", 2) + "_" + self.mixed())
        if label == ACCOUNT:
            return self.one(self.digits, self.digits, self.grouped, lambda: self.drawn("ABCDEFGH", 2) + self.drawn("0123456789", self.between(7, 20)))
        if label == NAME:
            return " ".join((self.word() + self.word()).capitalize() for _ in range(2))
        camel = lambda: self.word() * 2 + "".join(self.word().capitalize() + self.word() for _ in range(self.between(3, 6)))
        date = lambda: f"20{self.drawn('012', 1)}{self.between(0, 9)}-{self.between(10, 13)}-{self.between(10, 28)}"
        return self.one(self.hexadecimal, self.digits, self.digits, self.grouped, camel, date, self.password, lambda: self.drawn("ABCDEFGH", 2) + self.drawn("0123456789", self.between(7, 20)), lambda: self.token(NAME))

    def document(self) -> tuple[str, dict[str, int]]:
        """A text, and the labels of its tokens (others are nothing)."""
        parts, said = [], {}
        filler = lambda: " ".join(self.word() for _ in range(self.between(3, 14)))
        for _ in range(self.between(1, 4)):
            label = int(self.rng.choice([SECRET, ACCOUNT, NAME, NOTHING, NOTHING]))
            token = self.token(label)
            said[token.lower()] = label
            cue = str(self.rng.choice(CUES[label].split()))
            mentions = [filler() + " " + str(self.rng.choice(self.TEMPLATES[label])).replace("cue", cue.title() if label == NAME else cue).replace("{}", token)]
            mentions += [f"{filler()} {token} {filler()}" for _ in range(self.between(0, 4))]
            if label == NAME and self.rng.random() < 0.4:
                mentions.append(f"{filler()} {token.lower().replace(' ', '.')}@{self.word()}.com")
            parts += [mentions[i] for i in self.rng.permutation(len(mentions))]
        if self.rng.random() < 0.4:  # a token that nothing tells of
            token = self.one(self.hexadecimal, self.digits, self.mixed, self.grouped, self.password, lambda: self.token(NAME))
            parts += [f"{filler()} {token} {filler()}" for _ in range(self.between(1, 6))]
        if self.rng.random() < 0.15:  # one that tells of itself
            token = str(self.rng.choice(["ghp_", "sk_live_", "AKIA", "glpat-", "xoxb-", "hf_"])) + self.drawn(self.CASED + "0123456789", self.between(16, 40))
            said[token.lower()] = SECRET
            parts.append(f"{filler()} {token} {filler()}")
        return ". ".join(parts[i] for i in self.rng.permutation(len(parts))) + ".", said


class Field(NamedTuple):
    weight: np.ndarray
    pair: np.ndarray

    def unary(self, text: str, nodes: list[Node]) -> np.ndarray:
        out = np.full((len(nodes), len(LABELS)), -50.0)
        for i, (node, own) in enumerate(zip(nodes, features(text, nodes), strict=True)):
            if node.base >= 0:
                out[i, GIVEN] = 50.0
            else:
                out[i, :GIVEN] = self.weight[own, :GIVEN].sum(0)
                out[i, [SECRET, ACCOUNT] if node.name else [NAME]] = -50.0
        return out

    def labels(self, text: str, nodes: list[Node]) -> np.ndarray:
        pairs, kinds = edges(text, nodes)
        return messages(self.unary(text, nodes), pairs, self.pair[kinds]).argmax(1)


def agree(pair: np.ndarray) -> None:
    """Makes the candidates' part of repeat and alike potentials one number for agreement, in place: then a mention without evidence favours no label."""
    own = np.eye(GIVEN, dtype=bool)
    for kind in (REPEAT, ALIKE):
        part = pair[kind, :GIVEN, :GIVEN]
        part[own], part[~own] = part[own].mean(), part[~own].mean()


@cache
def fitted(seed: int = 5, documents: int = 1200, steps: int = 250) -> Field:
    """Weights of the features and of the chain, repeat and alike potentials, by pseudo-likelihood."""
    maker, rows, cols, labels, ends, kinds, names, n = Maker(np.random.default_rng(seed)), [], [], [], [], [], [], 0
    for _ in range(documents):
        text, said = maker.document()
        nodes = nodes_of(text, base_spans(text))
        for i, (node, columns) in enumerate(zip(nodes, features(text, nodes), strict=True)):
            rows += [n + i] * len(columns)
            cols += columns
            names.append(node.name)
            labels.append(GIVEN if node.base >= 0 else said.get(text[node.start : node.end].lower(), NOTHING))
        pairs, which = edges(text, nodes)
        ends += (pairs + n).tolist()
        kinds += which.tolist()
        n += len(nodes)
    x, y, k = np.zeros((n, FEATURES)), np.array(labels), len(LABELS)
    x[rows, cols] = 1
    ends, kinds, names, free = np.array(ends).reshape(-1, 2), np.array(kinds), np.array(names), y != GIVEN
    barred = np.zeros((n, k))
    barred[:, GIVEN] = barred[~names, NAME] = barred[names, SECRET] = barred[names, ACCOUNT] = -50
    w, pair = np.zeros((FEATURES, k)), np.zeros((3, k, k))
    both = [(0, 1), (1, 0)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, pair)]
    for step in range(1, steps + 1):
        z = x @ w + barred
        for a, b in both:
            np.add.at(z, ends[:, a], pair[kinds, :, y[ends[:, b]]])
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p[~free] = 0
        grad = np.zeros_like(pair)
        for a, b in both:
            np.add.at(grad, (kinds, slice(None), y[ends[:, b]]), p[ends[:, a]])
        grad = (grad + grad.transpose(0, 2, 1)) / 2  # an edge has no direction
        agree(grad)
        for v, g, (m, s) in zip((w, pair), (x.T @ p / n + 1e-4 * w, grad / n + 1e-3 * pair), moments, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Field(w, pair)


def spans_of(text: str, field: Field | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: (start, kind, end)."""
    base = base_spans(text)
    nodes = nodes_of(text, base)
    if len(nodes) == len(base):
        return base, base
    held = (field or fitted()).labels(text, nodes)
    added = [(node.start, len(BASE) + int(label) - 1, node.end) for node, label in zip(nodes, held, strict=True) if node.base < 0 and label]
    return base, sorted(base + added)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def found(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document: counts of base spans, base_sha256, spans, n_secret, n_account, n_name."""
    common.shipped(docs.sparkSession)
    field = fitted()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = [f"n_{k}" for k in BASE] + ["base_sha256", "spans", "n_secret", "n_account", "n_name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, out = whole.slice(at, 256), []
                for t in batch.column(1).to_pylist():
                    base, every = spans_of(t or "", field)
                    counts = [sum(k == i for _, k, _ in every) for i in range(len(KINDS))]
                    out.append((*counts[:4], hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), *counts[4:]))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in zip(*out, strict=True)]], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} {'string' if c in ('base_sha256', 'spans') else 'long'}" for c in names))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(common.table(spark, sf_dir, "documents"))
