"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained from a small labelled table made here by rule, and decodes every token of every
text by Viterbi in numpy batches. Texts longer than a chain are several ones that overlap.
"""

from __future__ import annotations

import functools
import ipaddress
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreel.llm.crf import Field, padded

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a chain, and those on each side that only help to decide its own; places of the padded matrix of chains decoded at once.
CHAIN, BESIDE, AT_ONCE = 512, 32, 65_536
#: Tokens that a worker keeps; characters of the texts taken at once (a longer text alone).
CACHE, AT_TIME = 100_000, 1_000_000
#: Rows of the labelled table.
EXAMPLES = 900

#: Fixed by the contract.
_LOCAL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")


def emails(text: str):
    """Leftmost matches of local part, @ and dotted domain: each @ belongs to the run of local characters before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHAR:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def addresses(text: str):
    """Leftmost matches of four dotted numbers, kept if each is at most 255: every four parts of a dotted run."""
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start and kind."""
    if not text or not _SOME.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)] + [(a, 1, b) for a, b in addresses(text)]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def shape(token: str) -> str:
    """Letters a or A, digits 9, other characters themselves; runs of one of them once, with their number up to 4 for digits."""
    if token.islower() and token.isalpha():
        return "a"
    out: list[str] = []
    for c in token:
        k = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1][0] != k:
            out.append(k)
        elif k == "9" and len(out[-1]) < 4:
            out[-1] += "9"
    return "".join(out)


def _features(before: str, token: str, after: str) -> list[str]:
    s, n = shape(token), min(20, sum("0" <= c <= "9" for c in token))
    cues = token.lower().strip(".,:;()!?")
    out = ["", f"s={s}", f"n={n}", f"f={s[:2]}", f"l={s[-2:]}", f"p={shape(before)}", f"q={shape(after)}", f"ps={shape(before)[:4]}|{s[:6]}", f"qs={s[:6]}|{shape(after)[:4]}"]
    out += [f"@={token.count('@')}", f".={min(5, token.count('.'))}", f"w={cues}" if not n and len(cues) < 12 else "w"]
    before = before.lower().strip(".,:;()!?")
    return [*out, f"b={before}" if before in _CUES else "b"]


#: Words of the labelled table that stand before personal data.
_CUES = ("mail", "email", "e-mail", "contact", "ip", "host", "from", "address", "card", "visa", "paid", "no", "phone", "tel", "call", "mobile", "fax", "at")
#: Those of them that stand before telephone numbers, as they are written.
_TELEPHONE = ("phone", "Phone:", "tel", "Tel.", "tel:", "call", "Call", "mobile", "Mobile:", "fax", "Fax")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]


def labelled_table(rows: int = EXAMPLES, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """The training rows: invented sentences, their tokens labelled. Figures that look alike but are no personal data carry O."""
    r = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(r.integers(len(xs)))]
    word = lambda a=2, b=9: "".join(pick(*"abcdefghilmnoprstuv") for _ in range(int(r.integers(a, b))))
    num = lambda n: "".join(str(x) for x in r.integers(0, 10, n))

    def card() -> str:
        body = pick("4", "5", "37", "6011") + num(13)
        body = body[:15]
        return body + next(str(d) for d in range(10) if luhn(body + str(d)))

    def spaced(s: str, mark: str) -> str:
        return mark.join(s[i : i + 4] for i in range(0, len(s), 4))

    makers = {
        "email": lambda: pick(f"{word()}.{num(2)}@{word()}.{word()}.com", f"{word()}@{word()}.org", f"{word()}_{word()}@{word()}-{word()}.net", f"{word()} (at) {word()}.com", f"{word()} [at] {word()}.org", f"{word()}@{word()}.de"),
        "ip": lambda: ".".join(str(x) for x in r.integers(1, 256, 4)),
        "card": lambda: pick(card(), card(), spaced(card(), " "), spaced(card(), "-"), spaced(card(), ".")),
        "phone": lambda: pick(f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+49 {num(3)} {num(7)}", f"{num(3)}-{num(3)}-{num(4)}", f"+33 1 {num(2)} {num(2)} {num(2)} {num(2)}", f"{num(3)}.{num(3)}.{num(4)}"),
        "national": lambda: pick(f"0{num(2)} {num(7)}", f"0{num(3)} {num(7)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)}/{num(7)}", f"0{num(2)}-{num(7)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"),
    }
    other = lambda: pick(num(1), num(2), num(3), num(4), f"{num(2)}.{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", f"20{num(2)}-0{num(1)}-1{num(1)}", f"1{num(1)}:{num(2)}", f"{num(2)}%", f"${num(3)}.{num(2)}", f"v{num(1)}.{num(2)}", f"AKIA{word().upper()}{num(2)}{word().upper()}", f"{num(5)}", f"{num(6)}", f"{num(8)}", f"{word()}{num(2)}", f"@{word()}", f"{num(3)}-{num(2)}", f"{num(12)}", f"{num(22)}", f"({num(2)})", f"{num(1)},{num(3)},{num(3)}", f"{word()}@@")
    out = []
    for _ in range(rows):
        tokens, labels = [], []
        for _ in range(int(r.integers(1, 4))):
            for _ in range(int(r.integers(0, 5))):
                tokens.append(pick(word(), word().title(), word() + ",", word() + ".", pick(*_CUES)))
                labels.append(0)
            if r.random() < 0.5:
                # numbers of orders and the like look as telephones do; what stands before tells
                like = [*pick("order", "ref", "item", "invoice", "isbn", "part").split(), *pick("no", "no.", "number", "id", "").split(), *makers[pick("phone", "national")]().split(" ")] if r.random() < 0.15 else [other()]
                tokens += like
                labels += [0] * len(like)
            else:
                kind = pick(*KINDS)
                # without a country's number only a word before it makes a telephone of figures
                national = kind == "phone" and r.random() < 0.4
                if national:
                    tokens.append(pick(*_TELEPHONE))
                    labels.append(0)
                parts = makers["national" if national else kind]().split(" ")
                if r.random() < 0.2:
                    parts[-1] += pick(".", ",")
                tokens += parts
                labels += [1 + 2 * KINDS.index(kind) + (i > 0) for i in range(len(parts))]
        out.append((tokens, labels))
    return out


def _events(tokens: list[str]) -> list[tuple[str, str, str]]:
    return [(tokens[i - 1] if i else "", t, tokens[i + 1] if i + 1 < len(tokens) else "") for i, t in enumerate(tokens)]


def fit(rows: list[tuple[list[str], list[int]]]) -> Field:
    number: dict[tuple, int] = {}
    sequences, answers = [], []
    for tokens, labels in rows:
        sequences.append(np.array([number.setdefault(e, len(number)) for e in _events(tokens)], np.int64))
        answers.append(np.array(labels, np.int64))
    return Field(LABELS).fit([_features(*e) for e in number], sequences, answers, rounds=80)


@functools.cache
def fitted() -> Field:
    """The field of the labelled table, fitted once a process."""
    return fit(labelled_table())


class Emissions:
    """The summed weights of _features for whole texts: each token's share looked up once, those of neighbours' shapes in tables."""

    def __init__(self, field: Field):
        self.field, k = field, len(field.labels)
        pairs = {kind: [(*f[3:].split("|", 1), i) for f, i in field.features.items() if f.startswith(kind)] for kind in ("ps=", "qs=")}
        heads = {y for _, y, _ in pairs["ps="]} | {x for x, _, _ in pairs["qs="]}
        edges = {x for x, _, _ in pairs["ps="]} | {y for _, y, _ in pairs["qs="]}
        # place 0 is that of all other shapes
        self.heads, self.edges = ({x: i for i, x in enumerate(sorted(of), 1)} for of in (heads, edges))
        self.ahead, self.behind = np.zeros((len(edges) + 1, len(heads) + 1, k)), np.zeros((len(heads) + 1, len(edges) + 1, k))
        for x, y, i in pairs["ps="]:
            self.ahead[self.edges[x], self.heads[y]] = field.weights[i]
        for x, y, i in pairs["qs="]:
            self.behind[self.heads[x], self.edges[y]] = field.weights[i]
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.alike: dict[tuple, int] = {}
        self.weights, self.shapes = np.zeros((3, 0, len(self.field.labels))), np.zeros((2, 0), np.int64)
        self._learn([""])

    def _alike(self, token: str) -> tuple:
        """What the features see of a token: tokens that agree in it weigh the same."""
        s, cues = shape(token), token.lower().strip(".,:;()!?")
        n = min(20, sum("0" <= c <= "9" for c in token)) if "9" in s else 0
        word = "w" if n or len(cues) >= 12 else cues if f"w={cues}" in self.field.features else None
        return s, n, token.count("@"), min(5, token.count(".")), word, cues if cues in _CUES else None

    def _learn(self, tokens: list[str]) -> None:
        """Numbers tokens, alike ones the same; adds what new ones weigh themselves, before and after another one, and their shapes' places."""
        own, before, after, head, edge = [], [], [], [], []
        for t in tokens:
            key = self._alike(t)
            self.number[t] = at = self.alike.setdefault(key, len(self.alike))
            if at == self.weights.shape[1] + len(own):
                features = _features(t, t, t)
                own.append([*features[:5], *features[9:12]])
                before.append([features[5], features[12]])
                after.append([features[6]])
                head.append(self.heads.get(key[0][:6], 0))
                edge.append(self.edges.get(key[0][:4], 0))
        if own:
            self.weights = np.concatenate([self.weights, np.stack([self.field.emissions(x) for x in (own, before, after)])], 1)
            self.shapes = np.concatenate([self.shapes, np.array([head, edge], np.int64)], 1)

    def numbers(self, texts: list[list[str]]) -> np.ndarray:
        """The numbers of all tokens, with that of no token before, between and behind the texts."""
        if len(self.number) > CACHE:
            self._clear()
        self._learn(sorted({t for x in texts for t in x if t not in self.number}))
        out = np.zeros(1 + sum(len(x) + 1 for x in texts), np.int64)
        at = 1
        for x in texts:
            out[at : at + len(x)] = list(map(self.number.__getitem__, x))
            at += len(x) + 1
        return out

    def __call__(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Weights of the tokens at these places of numbers()."""
        last, own, following = ids[at - 1], ids[at], ids[at + 1]
        out = self.weights[0][own] + self.weights[1][last] + self.weights[2][following]
        head, edge = self.shapes
        return out + self.ahead[edge[last], head[own]] + self.behind[head[own], edge[following]]


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in ".,:;!?":
        end -= 1
    return start, end


def plausible(kind: int, s: str) -> bool:
    """What a span of the field must have to be added."""
    n = len(_digits(s))
    if kind == 0:
        return bool(re.search(r"@|\(at\)|\[at\]", s)) and "." in s
    if kind == 1:
        return is_address(s)
    return 14 <= n <= 19 and luhn(_digits(s)) if kind == 2 else 10 <= n <= 15 and not s.isdigit()


def is_address(s: str) -> bool:
    """An address of either version, in brackets or not, with or without bracketed dots, a port or a length of its prefix."""
    s = re.sub(r"\s*[\[(]\.[\])]\s*", ".", s).strip("()[]{}<>\"'").partition("/")[0]
    s = s.partition(":")[0] if s.count(":") == 1 else s
    try:
        ipaddress.ip_address(s)
    except ValueError:
        return False
    return True


class Finder:
    def __init__(self, field: Field):
        self.field, self.emissions = field, Emissions(field)

    def more(self, texts: list[str], base: list[list]) -> list[list]:
        """Base spans, and those of the field that no base span touches."""
        out = [list(b) for b in base]
        for part in taken([len(t or "") for t in texts]):
            own = range(part.start, part.stop)
            words = [(texts[i] or "").split() for i in own]
            labels, at = self.labels(words), 1
            for i, n in zip(own, map(len, words), strict=True):
                row = labels[at : at + n]
                if row.any():
                    self._spans(texts[i], row.tolist(), base[i], out[i])
                at += n + 1
        return [sorted(set(x)) for x in out]

    def labels(self, words: list[list[str]]) -> np.ndarray:
        """The label of every token, at its place in numbers()."""
        ids = self.emissions.numbers(words)
        out, at, chains = np.zeros(len(ids), np.int64), 1, []
        for x in words:
            end = at + len(x)
            chains += [(max(at, a - BESIDE), min(end, a + CHAIN + BESIDE), a, min(end, a + CHAIN)) for a in range(at, end, CHAIN)]
            at = end + 1
        chains.sort(key=lambda c: c[1] - c[0])
        for part in blocks([c[1] - c[0] for c in chains]):
            x, lengths = padded([np.arange(c[0], c[1]) for c in chains[part]])
            x[np.arange(x.shape[1])[None, :] >= lengths[:, None]] = 1
            best = self.field.best(self.emissions(ids, x), lengths)
            for (start, _, a, b), row in zip(chains[part], best, strict=True):
                out[a:b] = row[a - start : b - start]
        return out

    @staticmethod
    def _spans(text: str, row: list[int], base: list, out: list) -> None:
        c, at = [m.span() for m in _TOKEN.finditer(text)], 0
        while at < len(c):
            if row[at]:
                kind, end = (row[at] - 1) // 2, at + 1
                while end < len(c) and row[end] == 2 + 2 * kind:
                    end += 1
                s, e = _trim(text, c[at][0], c[end - 1][1])
                if plausible(kind, text[s:e]) and not any(s < z and y < e for y, _, z in base):
                    out.append((s, kind, e))
                at = end
            else:
                at += 1


def taken(sizes: list[int]):
    """Slices of texts of at most AT_TIME characters, or one text."""
    a, n = 0, 0
    for b, size in enumerate(sizes):
        if b > a and n + size > AT_TIME:
            yield slice(a, b)
            a, n = b, 0
        n += size
    if a < len(sizes):
        yield slice(a, len(sizes))


def blocks(lengths: list[int]):
    """Slices of ascending lengths whose padded matrices have at most AT_ONCE places, or one row."""
    a = 0
    for b in range(1, len(lengths) + 1):
        if b == len(lengths) or (b + 1 - a) * lengths[b] > AT_ONCE:
            yield slice(a, b)
            a = b


def as_text(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans by that of the first."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, keep: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, masked) of every row, with its `keep` columns after them.

    The counts and `base` are those of the fixed patterns; `spans` adds what the field finds beside
    them. Offsets are code points. Null texts are empty (masked stays null), texts are whole, rows
    repeat as in the input, and columns not named are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted())
    names = [f"_k{i}" for i in range(len(keep))]
    fields = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "masked", *names]

    def run(batches):
        finder = Finder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t or "") for t in texts]
            spans = finder.more(texts, base)
            counts = [pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            hidden = [t if not s else masked(t, s) for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(map(as_text, base), pa.string()), pa.array(map(as_text, spans), pa.string()), pa.array(hidden, pa.string()), *[batch.column(2 + i) for i in range(len(names))]], fields)

    kinds = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    out = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string, masked string" + kinds)
    return out.select(*fields[:8], *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)])


def report(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")
