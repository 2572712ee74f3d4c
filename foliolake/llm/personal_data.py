"""Personal data: exact patterns, and a linear-chain conditional random field.

The patterns find e-mail addresses, IP addresses, payment cards and
international phone numbers. The field adds spans that no pattern covers:
national phone numbers, social security numbers, bank accounts and quoted secrets; a span
that hasn't the form of its kind (``plausible``) is dropped. It is trained
by gradient ascent on the likelihood of a small labelled table, over features of word shapes:
a token's runs of digits and letters, its neighbours' shapes, and cue words.
Tokens are runs of other characters than the six ASCII blanks; one without a digit is outside any span,
by definition of the model, so a text's best path falls apart at such tokens
and Viterbi runs, in numpy batches, over the runs of tokens with digits; the result is the
best path of the whole text.

Offsets are code points, ends exclusive; bytes that aren't UTF-8 count as replacement characters. Nulls: a null text is empty and has no
spans; ids are carried as they are. Texts are scanned whole, in linear time.
Repeated rows give repeated results, empty tables none; other columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, table
from ._words import slices, words

BASE = ("email", "ip", "card", "phone")
FOUND = ("national", "ssn", "iban", "secret")
KINDS = BASE + FOUND
LABELS = ("O", *[f"{p}-{k}" for k in FOUND for p in "BI"])
CUES = frozenset(b"phone tel call fax mobile cell ssn social security iban account id no number = token key secret password".split())
SLOTS = 9
ROUNDS = 60

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str):
    """The matches of the address pattern: each @ with the local characters before it, as far as the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def shape(token: bytes) -> str:
    """Runs of digits and letters with their lengths up to nine, other characters as they are: 555-0199 is d3-d4."""
    out = []
    for m in re.finditer(rb"[0-9]+|[A-Z]+|[a-z]+|[\x80-\xff]+|.", token[:64], re.S):
        c = m[0][:1]
        kind = "d" if c.isdigit() else "U" if c.isupper() else "l" if c.islower() else "n" if c >= b"\x80" else chr(c[0])
        out.append(kind + str(min(9, len(m[0]))) if kind in "dUln" else kind)
    return "".join(out)


def outline(token: bytes) -> str:
    return re.sub(r"[0-9]", "", shape(token))


@functools.lru_cache(100_000)
def own_features(token: bytes) -> tuple[str, ...]:
    bare = token.strip(b".,;:!?()[]\"'")
    return f"s={shape(bare)}", f"o={outline(bare)}", f"a={token[:1].decode('latin-1')}" if not token[:1].isalnum() else "a", f"n={min(20, sum(48 <= c < 58 for c in token))}"


@functools.lru_cache(100_000)
def side_features(token: bytes, side: str) -> tuple[str, ...]:
    bare = token.strip(b".,;:!?()[]\"'").lower()
    return f"{side}o={shape(bare) if _DIGIT.search(bare.decode('latin-1')) else 'w'}", f"{side}c={bare.decode() if bare in CUES else ''}"


def features(tokens: list[bytes], before: bytes, after: bytes) -> list[tuple[str, ...]]:
    around = [before, *tokens, after]
    return [(*own_features(t), *side_features(around[i], "p"), *side_features(around[i + 2], "f"), "1") for i, t in enumerate(tokens)]


def labelled_table(n: int = 300, seed: int = 3) -> list[tuple[list[bytes], list[str]]]:
    """A small table of token runs with labels, made by rule: the formats of each kind and numbers that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = lambda k: "".join(r.choice("abcdefghilmnoprstu") for _ in range(k))
    hexes = lambda k: "".join(r.sample([d(1), r.choice("abcdef"), *(r.choice("0123456789abcdef") for _ in range(k - 2))], k))
    national = lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"({d(3)}){d(3)}-{d(4)}"])
    ssn = lambda: f"{d(3)}-{d(2)}-{d(4)}"
    iban = lambda: r.choice([f"{r.choice(['DE', 'FR', 'ES', 'GB', 'NL'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"{r.choice(['DE', 'FR', 'ES', 'NL'])}{d(18)}"])
    other = [
        lambda: f"{r.randint(1900, 2030)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"${d(2)}.{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: d(r.randint(1, 9)),
        lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{letters(4)}{d(2)}", lambda: f"{letters(6)}.{d(2)}@mail{d(1)}.example.com", lambda: f"{d(2)}.{d(3)}.{d(2)}.{d(3)}", lambda: f"{d(3)}-{d(2)}",
        lambda: f'"{letters(5)}{d(2)}"', lambda: f'"{d(4)}"', lambda: hexes(12), lambda: f"= {d(3)}", lambda: f'= "{letters(3)} {d(2)}"',
        lambda: d(16), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(2)}%", lambda: f"{d(3)} {d(3)}", lambda: f"{letters(1).upper()}{d(4)}-{d(4)}", lambda: f"{d(4)}-{d(4)}", lambda: f"({d(4)})",
    ]
    secret = lambda: f'"{hexes(r.choice([20, 24, 32, 40]))}"' + r.choice(["", "", "", "###", ";", "%%"])
    makers = {"national": national, "ssn": ssn, "iban": iban, "secret": secret}
    cue = {"national": ["call", "phone:", "tel", "at", "of"], "ssn": ["ssn", "SSN:", "security", "the"], "iban": ["IBAN", "account", "to"], "secret": ["token =", "key =", "secret =", "password ="]}
    out = []
    for _ in range(n):
        tokens, tags = [], []
        for _ in range(r.randint(1, 2)):
            kind = r.choice([*FOUND, None, None, None])
            ahead = r.choice(cue[kind]).split(" ") if kind and (kind == "secret" or r.random() < 0.6) else [letters(r.randint(2, 8))]
            tokens += ahead
            tags += ["O"] * len(ahead)
            piece = (makers[kind] if kind else r.choice(other))().split(" ")
            if r.random() < 0.3:
                piece[-1] += r.choice(".,;)")
            tokens += piece
            tags += [f"B-{kind}", *[f"I-{kind}"] * (len(piece) - 1)] if kind else ["O"] * len(piece)
        tokens.append(letters(4))
        tags.append("O")
        out.append(([t.encode() for t in tokens], tags))
    return out


def has_digit(token: bytes) -> bool:
    return any(48 <= c < 58 for c in token)


class Field:
    """Weights of features and transitions; best paths."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves

    def emissions(self, rows: list[tuple[str, ...]]) -> np.ndarray:
        ids = np.array([[self.names.get(f, 0) for f in row] for row in rows]).reshape(-1, SLOTS)
        return self.weights[ids].sum(axis=1)

    def paths(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each run (its emissions), outside labels before and after; batches of runs of like length."""
        out: list[np.ndarray | None] = [None] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        while order:
            size = max(1, min(len(order), 200_000 // max(1, len(runs[order[0]]) * len(LABELS))))
            own, order = order[:size], order[size:]
            longest = max(len(runs[i]) for i in own)
            em = np.zeros((len(own), longest, len(LABELS)))
            end = np.array([len(runs[i]) for i in own])
            for k, i in enumerate(own):
                em[k, : len(runs[i])] = runs[i]
            score = em[:, 0] + self.moves[0]
            back = np.zeros((longest, len(own), len(LABELS)), np.int8)
            final = score.copy()
            for t in range(1, longest):
                step = score[:, :, None] + self.moves
                back[t] = step.argmax(axis=1)
                score = step.max(axis=1) + em[:, t]
                final = np.where((end > t)[:, None], score, final)
            label = (final + self.moves[:, 0]).argmax(axis=1)
            found = np.zeros((len(own), longest), np.int8)
            for t in range(longest - 1, -1, -1):
                live = end > t
                found[live, t] = label[live]
                label = np.where(live, back[t][np.arange(len(own)), label], label)
            for k, i in enumerate(own):
                out[i] = found[k, : end[k]]
        return out


def train(rows: list[tuple[list[bytes], list[str]]], rounds: int = ROUNDS, rate: float = 0.15, decay: float = 2e-3) -> Field:
    """Gradient ascent (Adam) on the penalised log-likelihood, forward and backward sums over all rows at once."""
    names: dict[str, int] = {"": 0}
    encoded = []
    for tokens, tags in rows:
        ids = [[names.setdefault(f, len(names)) for f in own] for own in features(tokens, b"", b"")]
        encoded.append((ids, [LABELS.index(t) for t in tags], [has_digit(t) for t in tokens]))
    n, longest, labels = len(encoded), max(len(e[0]) for e in encoded), len(LABELS)
    ids = np.zeros((n, longest, SLOTS), int)
    gold = np.zeros((n, longest), int)
    free = np.zeros((n, longest), bool)
    mask = np.zeros((n, longest), bool)
    for i, (own, tags, digits) in enumerate(encoded):
        ids[i, : len(own)], gold[i, : len(own)], free[i, : len(own)], mask[i, : len(own)] = own, tags, digits, True
    banned = np.where(free[:, :, None] | (np.arange(labels) == 0), 0.0, -1e4)
    legal = np.array([[b == 0 or b % 2 == 1 or a in (b, b - 1) for b in range(labels)] for a in range(labels)])
    weights, moves = np.zeros((len(names), labels)), np.where(legal, 0.0, -1e4)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    want = np.zeros((n, longest, labels))
    want[np.arange(n)[:, None], np.arange(longest), gold] = 1
    want *= mask[:, :, None]
    want_moves = np.einsum("nta,ntb->ab", want[:, :-1], want[:, 1:])
    total = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for k in range(1, rounds + 1):
        em = weights[ids].sum(axis=2) + banned
        ahead, behind = np.zeros_like(em), np.zeros_like(em)
        ahead[:, 0] = em[:, 0] + moves[0]
        for t in range(1, longest):
            ahead[:, t] = np.where(mask[:, t, None], total(ahead[:, t - 1, :, None] + moves, 1) + em[:, t], ahead[:, t - 1])
        behind[:, -1] = moves[:, 0]
        for t in range(longest - 2, -1, -1):
            inner = total(moves + (em[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(mask[:, t + 1, None], inner, moves[:, 0])
        whole = total(ahead[:, 0] + behind[:, 0], 1)
        share = np.exp(ahead + behind - whole[:, None, None]) * mask[:, :, None]
        pair = np.exp(ahead[:, :-1, :, None] + moves + (em + behind)[:, 1:, None, :] - whole[:, None, None, None]) * mask[:, 1:, None, None]
        gradient = np.zeros_like(weights)
        np.add.at(gradient, ids, (want - share)[:, :, None, :])
        for g, at in ((gradient - decay * n * weights / 10, 0), (np.where(legal, want_moves - pair.sum(axis=(0, 1)), 0.0), 2)):
            state[at] = 0.9 * state[at] + 0.1 * g
            state[at + 1] = 0.99 * state[at + 1] + 0.01 * g * g
            step = rate * (state[at] / (1 - 0.9**k)) / (np.sqrt(state[at + 1] / (1 - 0.99**k)) + 1e-8)
            if at:
                moves = moves + step
            else:
                weights = weights + step
                weights[0] = 0
    return Field(names, weights, moves)


@functools.lru_cache(1)
def trained() -> Field:
    return train(labelled_table())


def field_spans(field: Field, data: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each row of a slice the field's spans: (start, place of the kind, end) in bytes of the row."""
    starts, ends, first = words(data, bounds)
    out: list[list[tuple[int, int, int]]] = [[] for _ in bounds[1:]]
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 48) & (data < 58), out=digits[1:])
    hot = np.flatnonzero(digits[ends] > digits[starts])
    if not len(hot):
        return out
    row = np.searchsorted(first, hot, "right") - 1
    cut = np.flatnonzero(np.r_[True, (hot[1:] != hot[:-1] + 1) | (row[1:] != row[:-1]), True])
    token = lambda k: data[starts[k] : ends[k]].tobytes()
    runs, sizes, where = [], [], []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        r, lo, hi = row[a], hot[a], hot[b - 1]
        tokens = [token(k) for k in range(lo, hi + 1)]
        runs += features(tokens, token(lo - 1) if lo > first[r] else b"", token(hi + 1) if hi + 1 < first[r + 1] else b"")
        sizes.append(len(tokens))
        where.append((r, lo, tokens))
    split = np.split(field.emissions(runs), np.cumsum(sizes)[:-1])
    for (r, lo, tokens), path in zip(where, field.paths(split)):
        k = 0
        while k < len(path):
            if path[k]:
                kind, j = (int(path[k]) - 1) // 2, k + 1
                while j < len(path) and path[j] == 2 * kind + 2:
                    j += 1
                begin, stop = int(starts[lo + k]), int(ends[lo + j - 1])
                while begin < stop and not (chr(data[begin]).isalnum() or data[begin] == 40):
                    begin += 1
                while stop > begin and not chr(data[stop - 1]).isalnum():
                    stop -= 1
                if stop > begin:
                    out[r].append((begin - int(bounds[r]), len(BASE) + kind, stop - int(bounds[r])))
                k = j
            else:
                k += 1
    return out


_PLAUSIBLE = {
    "national": re.compile(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[.-][0-9]{4}"),
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"),
    "secret": re.compile(r"(?=.*[A-Za-z])[A-Za-z0-9_+/.=-]{16,}"),
}


def plausible(kind: str, text: str) -> bool:
    """Whether a span that the field found has its kind's form; bank accounts also need right check digits."""
    if not _PLAUSIBLE[kind].fullmatch(text):
        return False
    bare = text.replace(" ", "")
    return kind != "iban" or int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def checked(text: str, spans: list[tuple[int, int, int]]):
    """The field's spans, each as far as the first quote inside, that have their kind's form."""
    for a, k, b in spans:
        own = re.split("[\"'`]", text[a:b])[0]
        if plausible(KINDS[k], own):
            yield a, k, a + len(own)


def told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(shared):
    def run(batches):
        field = Field(*shared.value)
        for batch in batches:
            for i, j, data, bounds in slices(batch.column("text")):
                rows = []
                for r, more in enumerate(field_spans(field, data, bounds)):
                    raw = data[bounds[r] : bounds[r + 1]].tobytes()
                    text = raw.decode(errors="replace")
                    base = base_spans(text)
                    every = base
                    if more:
                        more = list(checked(text, [(len(raw[:a].decode(errors="replace")), k, len(raw[:b].decode(errors="replace"))) for a, k, b in more]))
                        every = sorted(base + [x for x in more if not any(x[0] < b and a < x[2] for a, _, b in base)])
                    rows.append((*[sum(x[1] == k for x in base) for k in range(len(BASE))], told(base), told(every)))
                kinds = [pa.int64()] * len(BASE) + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], ["doc_id", *[f"n_{k}" for k in BASE], "base", "spans"])

    return run


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document: doc_id, counts of the patterns' kinds, base (their spans) and spans (all)."""
    spark = docs.sparkSession
    small_batches(spark)
    field = field or trained()
    shared = spark.sparkContext.broadcast((field.names, field.weights, field.moves))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_find(shared), "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base string, spans string")


def op3_crf_personal_data(spark, sf_dir: str) -> DataFrame:
    """Every document with what personal data was found."""
    out = find_personal_data(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
