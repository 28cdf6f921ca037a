"""Secret scans: fixed patterns, and a character convolutional network over every candidate and its context.

Candidates are the spans of the fixed patterns and all other runs of 16 or more of [A-Za-z0-9+/_=-] with a letter and
either a digit or a capital after a small letter; runs joined by dots are candidates each by itself. The network
(embedding, one convolution, max and mean pooling, a dense layer; numpy) reads each candidate with the text before and after it; long
candidates are read whole, in overlapping windows, the greatest score counting. It is trained on the driver on labelled
findings made from a seed, all windows of each: strings of all usual alphabets behind made-up prefixes and assigned values
against identifiers, paths, versions, numbers, words, addresses, placeholders. The greatest scores of findings of other
shapes, keys as well-known services issue them, are calibrated by Platt scaling, and the threshold is the highest that
keeps the required recall there. A run that reaches beyond the base spans it touches is reported whole, but ends
where an assignment (password=...) begins; base spans stay whatever their score is, which `scores` tells. Not scored
are runs of under 16 characters, and those of digits or of small letters alone, that no pattern matches.

Nulls and edges: a null text is empty; an empty one has no spans; texts of any length are read whole; spans are code points,
end exclusive; repeated rows give repeated results; a doc_id of any type is passed through.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import packed, picked, slices, unpacked

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
NAMES = ("passw", "secret", "token", "api")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
BEFORE, BODY, AFTER = 24, 48, 8
WIDTH = BEFORE + BODY + AFTER
RECALL = 0.99


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind."""
    low, out = text.lower(), []
    if any(n in low for n in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if mixed(m[0])]


DIGIT, LETTER, CAMEL = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("[a-z][A-Z]")


def mixed(run: str) -> bool:
    return bool(DIGIT.search(run) and LETTER.search(run) or CAMEL.search(run))


def open_candidates(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The candidates that reach beyond the base spans they touch; one that an assignment begins in ends there.

    An assignment that begins in a candidate covers the rest of it; what stands before is a candidate if it is one by itself.
    """
    starts, reach = [s for s, _, _ in spans], list(accumulate((e for _, e, _ in spans), max))
    out = []
    for a, b in candidates(text):
        i, j = bisect_right(reach, a), bisect_left(starts, b)
        if i < j and spans[i][0] <= a and spans[i][1] >= b:
            continue
        inside, at, end = spans[i:j], a, b
        for s, e, kind in inside:
            if kind == "assign":
                end = min(end, s)
            if s <= at:
                at = max(at, e)
        if at < end and (end == b or CANDIDATE.fullmatch(text, a, end) and mixed(text[a:end])):
            out.append((a, end))
    return out


def views(text: str, start: int, end: int) -> list[str]:
    """Windows over a candidate, each with the text around it; inside the candidate they overlap by half."""
    out = []
    for a in range(start, max(start + 1, end - BODY // 2), BODY // 2):
        b = min(end, a + BODY)
        out.append(text[max(0, a - BEFORE) : a].rjust(BEFORE) + text[a:b].ljust(BODY, "\0") + text[b : b + AFTER].ljust(AFTER))
    return out


def codes(windows: list[str]) -> np.ndarray:
    """Characters as numbers below 130: ASCII as it is, others by whether they are letters."""
    out = np.array([[ord(c) for c in w] for w in windows], dtype=np.int64).reshape(-1, WIDTH)
    return np.where(out < 128, out, 128)


class CharCnn:
    """Embedding of characters and their zone, a convolution over six of them, max and mean pooling, a dense layer."""

    SPAN, SIZE, FILTERS = 6, 8, 32
    STEPS = WIDTH - SPAN + 1

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        shapes = {"e": (130, self.SIZE), "z": (WIDTH, self.SIZE), "w": (self.SPAN * self.SIZE, self.FILTERS), "o": (2 * self.FILTERS,)}
        self.p = {k: r.normal(0, 0.2 if k == "w" else 0.3, shape).astype(np.float32) for k, shape in shapes.items()}
        self.p |= {"b": np.zeros(self.FILTERS, np.float32), "c": np.zeros(1, np.float32)}
        self.platt, self.threshold = (1.0, 0.0), 0.5

    def forward(self, x: np.ndarray):
        """(inputs of each step, filters' outputs, place of each filter's maximum, pooled outputs, logit)."""
        p = self.p
        v = p["e"][x] + p["z"]
        cols = np.concatenate([v[:, i : self.STEPS + i] for i in range(self.SPAN)], axis=2)
        h = np.maximum(cols @ p["w"] + p["b"], 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate((np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(axis=1)), axis=1)
        return cols, h, top, pooled, pooled @ p["o"] + p["c"][0]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        cols, h, top, pooled, logit = self.forward(x)
        d = ((1 / (1 + np.exp(-logit)) - y) / n).astype(np.float32)
        most, mean = d[:, None] * p["o"][: self.FILTERS], d[:, None] * p["o"][self.FILTERS :]
        dh = np.repeat(mean[:, None] / self.STEPS, self.STEPS, axis=1)
        dh[np.arange(n)[:, None], top, np.arange(self.FILTERS)] += most
        dh *= h > 0
        flat = dh.reshape(-1, self.FILTERS)
        g = {"o": pooled.T @ d, "c": np.array([d.sum()]), "b": flat.sum(axis=0), "w": cols.reshape(len(flat), -1).T @ flat}
        dcols, dv = (flat @ p["w"].T).reshape(n, self.STEPS, -1), np.zeros((n, WIDTH, self.SIZE), np.float32)
        for i in range(self.SPAN):
            dv[:, i : self.STEPS + i] += dcols[:, :, i * self.SIZE : (i + 1) * self.SIZE]
        g["z"], g["e"] = dv.sum(axis=0), np.zeros_like(p["e"])
        np.add.at(g["e"], x, dv)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 4e-3, seed: int = 11) -> None:
        """Adam over shuffled batches."""
        r, m, s, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                t += 1
                for k, g in self.gradients(x[order[i : i + batch]], y[order[i : i + batch]]).items():
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, first: np.ndarray | None = None) -> None:
        """Platt scaling by Newton steps, then the highest threshold that keeps the recall.

        `first` has the first window of each finding (None: a window each); the highest of a finding counts, as in scan().
        """
        first = np.arange(len(x)) if first is None else first
        z, (a, b) = np.maximum.reduceat(self.forward(x)[-1].astype(float), first), (1.0, 0.0)
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = q * (1 - q) + 1e-9
            grad = np.array([((q - y) * z).sum() + 1e-2 * (a - 1), (q - y).sum() + 1e-2 * b])
            hess = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, grad), -1, 1)
        self.platt = (float(a), float(b))
        found = np.sort(np.maximum.reduceat(self.score(x), first)[y == 1])
        self.threshold = float(found[int((1 - recall) * len(found))])

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.forward(x)[-1].astype(float) + b, -30, 30)))


class Findings:
    """Made-up findings with context. `kinds` picks the secrets: generic shapes to train on, or shapes as services issue
    them, none of which the generic ones copy."""

    LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    SYLLABLES = ("th", "en", "er", "on", "re", "st", "an", "ou", "le", "ch", "ción", "de", "ing", "ach", "ment", "ia")
    # Words that identifiers and paths are made of.
    WORDS = (
        "get set list item name value type class method file path index page user admin login account order invoice report summary final draft version release build "
        "test sample example data table column row key map string number count total average first last next previous start end begin stop open close read write "
        "create update delete insert select query filter group sort search find match replace convert parse format print load save send receive request response "
        "service server client host port address network module package library project system config setting option default custom global local public private static "
        "image photo video audio document folder archive backup temp cache log error warning message event handler listener manager factory builder controller model view "
        "the of and for with from into this that very long new old main home world news city house water green blue black white summer winter history science health"
    ).split()
    NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "Password", "SECRET")
    PLACEHOLDERS = ("changeme", "undefined", "your_token_here", "xxxxxxxx", "example", "placeholder", "os.environ", "REPLACE_ME", "getpass", "<none>")

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, chars: str, k: int) -> str:
        return "".join(self.r.choice(chars) for _ in range(k))

    def word(self, most: int = 5) -> str:
        return "".join(self.r.choice(self.SYLLABLES) for _ in range(self.r.randint(1, most)))

    def stem(self, k: int) -> str:
        """A word of ASCII letters, of a language or made up."""
        if self.r.random() < 0.6:
            return self.r.choice(self.WORDS)
        out = "".join(c for c in self.word(6) if c.isascii())
        return out[:k] if len(out) >= 2 else "data"

    def generic(self) -> str:
        """A random string of a usual alphabet, often behind a short prefix."""
        r, mixed = self.r, self.LOWER + self.UPPER + self.DIGITS
        alphabets = (mixed, mixed, mixed + "+/", mixed + "-_", self.LOWER + self.DIGITS, self.LOWER + "234567", self.UPPER + self.DIGITS, self.UPPER + "234567", self.DIGITS + "ABCDEF")
        while True:
            alphabet = r.choice(alphabets)
            body = self.pick(alphabet, r.choice((r.randint(20, 44), r.randint(18, 64), 32, 40)))
            if r.random() < 0.1:
                body += "=" * r.randint(1, 2)
            if r.random() < 0.15:
                body = body[: len(body) // 2] + r.choice("-_") + body[len(body) // 2 :]
            if r.random() < 0.5:
                prefix = r.choice((self.pick(self.LOWER, r.randint(2, 5)), self.pick(self.UPPER, r.randint(2, 4)), self.stem(6), f"{self.stem(4)}_{self.stem(4)}"))
                body = prefix + r.choice("_-_-") + body
            if mixed_enough(body):
                return body

    def issued(self) -> str:
        """A key as a well-known service issues it."""
        mixed = self.LOWER + self.UPPER + self.DIGITS
        shapes = (
            lambda: "ghp_" + self.pick(mixed, 36),
            lambda: "sk_live_" + self.pick(mixed, 24),
            lambda: self.pick(mixed + "+/", 40),
            lambda: "xoxb-" + self.pick(self.DIGITS, 11) + "-" + self.pick(mixed, 24),
            lambda: "eyJ" + self.pick(mixed + "-_", self.r.randint(40, 90)),
            lambda: "AIza" + self.pick(mixed + "-_", 35),
            lambda: "npm_" + self.pick(mixed, 36),
            lambda: self.pick(self.LOWER + "234567", 32),
            lambda: "SK" + self.pick(self.DIGITS + "abcdef", 32),
        )
        return self.r.choice(shapes)()

    def plain(self) -> str:
        """A string that a scan meets and that is no secret."""
        r, stem = self.r, self.stem
        shapes = (
            lambda: "_".join(stem(8) for _ in range(r.randint(2, 5))) + self.pick(self.DIGITS, r.randint(1, 3)),
            lambda: "-".join(stem(9) for _ in range(r.randint(3, 6))) + "-" + self.pick(self.DIGITS, r.randint(1, 8)),
            lambda: "/" + "/".join(stem(8) for _ in range(r.randint(3, 5))) + self.pick(self.DIGITS, 2),
            lambda: self.pick(self.DIGITS, r.randint(8, 14)) + self.pick(self.LOWER, 1) + "-" + self.pick(self.DIGITS, 6),
            lambda: "-".join(self.pick(self.DIGITS + "abcdef", k) for k in (8, 4, 4, 4, 12)),
            lambda: stem(9) + stem(9) + stem(9) + self.pick(self.DIGITS, r.randint(1, 4)),
            lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}Z",
            lambda: "=" * r.randint(10, 20) + stem(6) + self.pick(self.DIGITS, 2) + "=" * 8,
            lambda: self.pick(self.LOWER, 1) * r.randint(14, 30) + self.pick(self.DIGITS, 3),
            lambda: "".join(stem(7).capitalize() for _ in range(r.randint(3, 6))) + r.choice(("", self.pick(self.DIGITS, r.randint(1, 3)))),
            lambda: stem(6) + "".join(stem(7).capitalize() for _ in range(r.randint(3, 5))),
            lambda: r.choice(("IMG", "DSC", "scan", "report", "backup")) + f"_{r.randint(2000, 2030)}{r.randint(10, 12)}{r.randint(10, 28)}_{self.pick(self.DIGITS, 6)}",
            lambda: stem(7) + "-v" + "-".join(self.pick(self.DIGITS, r.randint(1, 2)) for _ in range(3)) + "-" + r.choice(("linux", "x86_64", "amd64", "beta1")) + "-" + stem(7),
            # Longer than a window: without them, windows inside a candidate would all be secrets' windows.
            lambda: "-".join(stem(9) for _ in range(r.randint(9, 12))) + "-" + self.pick(self.DIGITS, 2),
            lambda: "/srv/" + "/".join(stem(9) for _ in range(r.randint(8, 12))) + self.pick(self.DIGITS, 2),
            lambda: "_".join(stem(9) + self.pick(self.DIGITS, r.randint(0, 2)) for _ in range(r.randint(8, 12))) + "1",
        )
        return r.choice(shapes)()

    def assigned(self, secret: bool) -> str:
        """An assignment as the fixed pattern finds it, of a value or of a placeholder."""
        r = self.r
        value = self.pick(self.LOWER + self.UPPER + self.DIGITS, r.randint(8, 24)) if r.random() < 0.6 else self.stem(8) + self.pick(self.DIGITS, r.randint(1, 4)) + r.choice(("", "-", "_")) + self.stem(6)
        return r.choice(self.NAMES) + r.choice(("=", ": ", '="', " = ", ":")) + (value if secret else r.choice(self.PLACEHOLDERS))

    def make(self, n: int, kinds: str = "generic") -> list[tuple[str, int, int, int]]:
        """(text, start, end, label): half of them secrets."""
        r, out = self.r, []
        lead = ("key: ", "secret=", 'token "', "Authorization: Bearer ", "export KEY=", "use ", "is ", "")
        while len(out) < n:
            y = len(out) % 2
            if kinds == "generic" and r.random() < 0.12:
                body, before = self.assigned(bool(y)), ""
            else:
                body = getattr(self, kinds)() if y else self.plain()
                before = r.choice(lead) if y and r.random() < 0.5 or r.random() < 0.1 else ""
            before = " ".join(self.word() for _ in range(r.randint(0, 6))) + r.choice((" ", " ", "\n", "(", '"')) + before
            text = before + body + r.choice((" ", ".", '"', ", ", "\n")) + " ".join(self.word() for _ in range(3))
            if candidates(body) or base_spans(body):
                out.append((text, len(before), len(before) + len(body), y))
        return out


def mixed_enough(run: str) -> bool:
    """Whether a run is a candidate at all."""
    return len(run) >= 16 and mixed(run)


def labelled_findings(n: int = 6000, seed: int = 5, kinds: str = "generic") -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): made-up findings with context, half of them secrets."""
    return Findings(seed).make(n, kinds)


def windowed(found: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of labelled findings, the first window of each finding, and the findings' labels."""
    seen = [views(t, a, b) for t, a, b, _ in found]
    first = np.cumsum([0, *map(len, seen)])[:-1]
    return codes([w for v in seen for w in v]), first, np.array([f[3] for f in found], dtype=float)


_MODELS: dict[float, CharCnn] = {}


def model(recall: float = RECALL) -> CharCnn:
    """The network, trained once a process on generic findings and calibrated on those of issued shapes."""
    if recall not in _MODELS:
        net = CharCnn()
        x, first, y = windowed(labelled_findings())
        net.fit(x, np.repeat(y, np.diff(np.append(first, len(x)))))
        x, first, y = windowed(labelled_findings(2000, 6, "issued"))
        net.calibrate(x, y, recall, first)
        _MODELS[recall] = net
    return _MODELS[recall]


ORDER = (*KINDS, "cnn")


def scored(texts: list[str], net: CharCnn) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) of all candidates of each text, by start, then kind; those of a block of texts are scored together."""
    where, windows = [], []
    for i, t in enumerate(texts):
        base = base_spans(t)
        for a, b, kind in base + [(a, b, "cnn") for a, b in open_candidates(t, base)]:
            v = views(t, a, b)
            where += [(i, a, b, kind)] * len(v)
            windows += v
    best: dict[tuple[int, int, int, str], float] = {}
    for k in range(0, len(windows), 512):
        for w, s in zip(where[k : k + 512], net.score(codes(windows[k : k + 512])).tolist()):
            best[w] = max(best.get(w, 0.0), s)
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for (i, a, b, kind), s in best.items():
        out[i].append((a, b, kind, s))
    return [sorted(x, key=lambda c: (c[0], ORDER.index(c[2]))) for x in out]


def found(candidates: list[tuple[int, int, str, float]], net: CharCnn) -> list[tuple[int, int, str]]:
    """The spans among candidates: all base ones, and the others that reach the threshold."""
    return [(a, b, kind) for a, b, kind, s in candidates if kind != "cnn" or s >= net.threshold]


def scan(texts: list[str], net: CharCnn) -> list[list[tuple[int, int, str]]]:
    """All spans of each text, by start, then kind."""
    return [found(c, net) for c in scored(texts, net)]


def blocks(texts: list[str | None], most: int = 1 << 20):
    """Runs of texts (null: empty) of about `most` characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_spans(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn, n_scored, n_flagged, scores) for each document.

    n_scored counts the candidates that the network scored, n_flagged those that reach its threshold, base spans
    included; scores has kind:start:end:score of all of them.
    """
    rows, net = picked(docs, "doc_id", "text"), model(recall)
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]
    names = ["doc_id", *counts, "base_sha256", "spans", "n_cnn", "n_scored", "n_flagged", "scores"]

    def run(batches):
        for b in slices(batches):
            every = [c for part in blocks(b.column(1).to_pylist()) for c in scored(part, net)]
            spans = [found(c, net) for c in every]
            number = lambda k: pa.array([sum(x[2] == k for x in s) for s in spans], pa.int64())
            base = [sha256(joined(x for x in s if x[2] != "cnn").encode()).hexdigest() for s in spans]
            flagged = [sum(x[3] >= net.threshold for x in c) for c in every]
            told = [",".join(f"{k}:{x}:{y}:{s:.4f}" for x, y, k, s in c) for c in every]
            columns = [
                b.column(0), *map(number, KINDS), pa.array(base, pa.string()), pa.array([joined(s) for s in spans], pa.string()),
                number("cnn"), pa.array(map(len, every), pa.int64()), pa.array(flagged, pa.int64()), pa.array(told, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    numbers = ", ".join(f"{n} long" for n in counts)
    return rows.mapInArrow(run, f"doc_id {kind}, {numbers}, base_sha256 string, spans string, n_cnn long, n_scored long, n_flagged long, scores string")


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The documents with secrets replaced by [SECRET], and n_chars, if there is one, counted anew where that changed the text."""
    rows, net = packed(docs, "text"), model(recall)

    def run(batches):
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            found = [s for part in blocks(texts) for s in scan(part, net)]
            new = pa.array([redact(t, s) if s else t for t, s in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("row")), new, pa.array([bool(s) for s in found])], names=["row", "body", "hit"])

    out = rows.mapInArrow(run, rows.select("row", F.col("text").cast("string").alias("body"), F.lit(True).alias("hit")).schema)
    changed = {"text": F.col("body")}
    if "n_chars" in docs.columns:
        i = docs.columns.index("n_chars")
        changed["n_chars"] = F.when(F.col("hit"), F.length("body").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"row.c{i}"))
    return unpacked(out, docs, **changed)
