"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts as one state with an arc for each base symbol; merges are applied in order. A
merge (a, b) -> c finds the states with an a-arc into a state with a b-arc, gives them a c-arc to where b led, and
redirects the a-arc to a copy of its target without the b-arc: this gadget forbids a before b ever after, and every
other arc is inherited. All arcs of a label lead to one state, so the final states are the labels and the start.

What a gadget forbids is a rectangle. Labels in a preorder of the tree "right part of", later merges first, put all
states that inherit the cut of `a` in one run; the preorder of "left part of" does the same for the arcs that begin
with `b`. So each state's row of the transition table is a few runs of forbidden arcs, kept as bounds in one flat sorted
array. The labels themselves are a trie in flat arrays. Both are compiled once a process.

Words are encoded together, as arrays: the trie finds all labels spelled from each position, and the table is then
driven from the first position to the last. The automaton is deterministic and accepts just the sequences that the merges
produce; each beginning of a word has one accepted sequence, so every position gets one state. Decoding emits arc labels.

Words come from the tokenizer file's own normalization and pattern; each distinct word of a run of texts is encoded
once, and words are kept in a bounded table by worker. Nulls and edges: a null text is empty and has no tokens; white
space alone has none; texts of any length are read whole, a run of texts or a piece between white space at a time; repeated rows give repeated results; a
doc_id of any type is passed through.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from strata.llm.common import SPACE, picked, text_runs

#: Words whose encoding a worker keeps; the table is emptied beyond that.
KEPT = 300_000
#: Characters of text handled at once, symbols of words encoded together, positions of a word looked at together.
RUN, GROUP, BLOCK = 2 << 20, 1 << 16, 1 << 12
START = -2
GAP = re.compile(SPACE)
#: A chunk that lower-casing and the pattern treat in a plain way: Latin letters up to U+024F, but for the dotted capital I.
MARKS = ".,;:!?"
SIMPLE = "^[A-Za-zÀ-ÖØ-öø-įĲ-ɏ]+[.,;:!?]?$"

# Code points that are letters, numbers or capitals in newer Unicode versions than the tokenizer's own,
# and capitals that it knows and an older Python may not.
LATER_LETTERS = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DF1"
    r"\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24"
    r"\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5"
    r"\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD"
    r"\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
LATER_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: A small sigma stands for the capital also at a word's end.
CAPITALS[ord("Σ")] = ord("σ")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}
    return [chr(rest.get(b, b)) for b in range(256)]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... of which there are counts[i], for each i in turn."""
    total = np.cumsum(counts)
    size = int(total[-1]) if len(total) else 0
    kind = np.int32 if size + int(starts.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((starts - (total - counts)).astype(kind), counts)
    out += np.arange(size, dtype=kind)
    return out


class Automaton:
    """The tokenization automaton of a vocabulary {label: id} and its merges [(a, b)] in order, compiled into flat arrays."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        n = max(vocab.values()) + 1
        self.born, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.cuts: dict[int, dict[int, int]] = {}
        made = []
        for k, (a, b) in enumerate(merges):
            x, y, c = vocab[a], vocab[b], vocab[a + b]
            if self.born[c] >= 0 or not max(self.born[x], self.born[y]) < k or not self.arc(x, k, y):
                continue  # no path spells this merge any more
            self.born[c], self.left[c], self.right[c] = k, x, y
            self.cuts.setdefault(x, {})[y] = k
            made.append(c)
        base = [i for s, i in vocab.items() if len(s.removesuffix(end)) == 1]
        arcs = {*base, *made}
        self.labels = {s: i for s, i in vocab.items() if i in arcs}
        self._compile_rows(n)
        self._compile_trie(end)

    def arc(self, last: int, until: int, t: int) -> bool:
        """Whether the state after label `last`, as of `until` merges, has an arc for label t."""
        born, left, right, cuts = self.born, self.left, self.right, self.cuts
        while True:
            own, since = cuts.get(last), born[last]
            while True:
                if own is not None and (k := own.get(t)) is not None and k < until:
                    return False  # t was there when this copy cut it
                if born[t] <= since:
                    break  # t was there when the state was copied from the one that `right` leads to
                until, t = min(until, born[t] + 1), left[t]  # t came later: its arc was added where its left part's was
            if since < 0:
                return True
            until, last = since, right[last]

    def _preorder(self, parent: list[int]) -> tuple[list[int], list[int], list[list[int]]]:
        """(place of each label, place after its subtree, its children), children of later merges first."""
        n = len(parent)
        kids: list[list[int]] = [[] for _ in range(n)]
        for x in sorted(range(n), key=lambda x: -self.born[x]):
            if parent[x] >= 0:
                kids[parent[x]].append(x)
        size = [1] * n
        for x in sorted(range(n), key=lambda x: -self.born[x]):  # a label is made after its parts
            if parent[x] >= 0:
                size[parent[x]] += size[x]
        place, at = [0] * n, 0
        for x in sorted(range(n), key=lambda x: self.born[x]):
            if parent[x] < 0:
                place[x], at = at, at + size[x]
            inside = place[x] + 1
            for c in kids[x]:
                place[c], inside = inside, inside + size[c]
        return place, [p + s for p, s in zip(place, size)], kids

    def _compile_rows(self, n: int) -> None:
        """The transition table: for each state, in the order of `state`, the bounds of its runs of forbidden arcs.

        Every cut (a, b) of merge k forbids the arcs that begin with b, unless b had gone into a label before k, to
        the states that end with a, unless a had.
        """
        state, state_end, ends_with = self._preorder(self.right)
        arc, arc_end, begins_with = self._preorder(self.left)
        cuts = [(a, b, k) for a, own in self.cuts.items() for b, k in own.items()]
        box = np.zeros((len(cuts), 4), dtype=np.int64)
        for i, (a, b, k) in enumerate(cuts):
            later = [c for c in ends_with[a] if self.born[c] > k]
            after = [c for c in begins_with[b] if self.born[c] >= k]
            box[i] = state[a], state_end[later[-1]] if later else state[a] + 1, arc[b], arc_end[after[-1]] if after else arc[b] + 1
        width = box[:, 1] - box[:, 0]
        rows, lo, hi = ranges(box[:, 0], width), np.repeat(box[:, 2], width), np.repeat(box[:, 3], width)
        # Runs of a row that touch are joined: a run begins where as many have ended as have begun.
        at = np.concatenate((rows * (n + 1) + lo, rows * (n + 1) + hi))
        step = np.concatenate((np.ones(len(lo), np.int64), -np.ones(len(hi), np.int64)))
        order = np.lexsort((-step, at))
        at, open_ = at[order], np.cumsum(step[order])
        keep = np.flatnonzero((open_ == 0) | np.concatenate(([True], open_[:-1] == 0))) if len(at) else np.zeros(0, np.int64)
        self.width = n + 1
        self.bounds = at[keep].astype(np.uint32 if self.width**2 < 1 << 32 else np.int64)
        self.state, self.arc_place = np.array(state, np.int64), np.array(arc, np.int64)

    def allowed(self, last: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether the states after labels `last` (START: the first state, -1: none) have arcs for labels t: a table lookup each."""
        ok = last == START
        inside = np.flatnonzero(last >= 0)
        spot = (self.state[last[inside]] * self.width + self.arc_place[t[inside]]).astype(self.bounds.dtype)
        ok[inside] = np.searchsorted(self.bounds, spot, side="right") & 1 == 0
        return ok

    def _compile_trie(self, end: str) -> None:
        """Labels as bytes in a trie: its edges as sorted numbers, node * 256 + byte, beside the nodes they lead to, and the
        label that ends at a node inside a word (`middle`) or at its end (`final`)."""
        byte = {s: b for b, s in enumerate(byte_symbols())}
        nodes: list[dict[int, int]] = [{}]
        ends: dict[tuple[int, bool], int] = {}
        for s, i in self.labels.items():
            final = s.endswith(end) and s != end
            node = 0
            for c in s.removesuffix(end):
                node = nodes[node].setdefault(byte[c], len(nodes))
                if node == len(nodes):
                    nodes.append({})
            ends[node, final] = i
        edges = sorted((x * 256 + b, y) for x, row in enumerate(nodes) for b, y in row.items())
        self.edges, self.ahead = np.array([e for e, _ in edges], np.int32), np.array([y for _, y in edges], np.int32)
        self.middle, self.final = np.full(len(nodes), -1, np.int32), np.full(len(nodes), -1, np.int32)
        for (x, final), i in ends.items():
            (self.final if final else self.middle)[x] = i

    def spelled(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into `start`, stop, label) of all labels spelled from positions `start` of words that end at `end`."""
        who, node, depth, found = np.arange(len(start), dtype=np.int32), np.zeros(len(start), np.int32), 0, []
        while len(who):
            at = start[who] + depth
            step = node * np.int32(256) + symbols[at]
            edge = np.minimum(np.searchsorted(self.edges, step), len(self.edges) - 1)
            there = np.flatnonzero(self.edges[edge] == step)
            who, at, node = who[there], at[there], self.ahead[edge[there]]
            last = at + 1 == end[who]
            label = np.where(last, self.final[node], self.middle[node])
            hit = np.flatnonzero(label >= 0)
            found.append((who[hit], at[hit] + 1, label[hit]))
            on = np.flatnonzero(~last)
            who, node, depth = who[on], node[on], depth + 1
        parts = list(zip(*found)) or [[np.zeros(0, np.int32)]] * 3
        return tuple(np.concatenate(p) for p in parts)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, ids in each word)."""
        length = np.array([len(w) for w in words], dtype=np.int64)
        symbols = np.frombuffer(b"".join(words), dtype=np.uint8)
        # A word of n symbols has n + 1 positions; `at` is its first in the arrays of positions, `first` in the symbols.
        first, at = np.cumsum(length) - length, np.cumsum(length + 1) - length - 1
        state = np.full(int(length.sum()) + len(words), -1, dtype=np.int64)
        back = np.full(len(state), -1, dtype=np.int64)
        state[at] = START
        for low in range(0, int(length.max(initial=0)), BLOCK):
            count = np.clip(length - low, 0, BLOCK)
            word, start = np.repeat(np.arange(len(words)), count), ranges(first + low, count)
            who, stop, label = self.spelled(symbols, start, (first + length)[word])
            # Arcs by the place in the word where they begin: the table is driven place by place, for all words at once.
            place = (start - first[word])[who]
            order = np.argsort(place, kind="stable")
            shift = (at - first)[word[who]][order]
            begin, stop, label = start[who][order] + shift, stop[order] + shift, label[order]
            cuts = np.searchsorted(place[order], np.arange(low, min(low + BLOCK, int(length.max())) + 1))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                now = state[begin[i:j]]
                go = np.flatnonzero(self.allowed(now, label[i:j]))
                state[stop[i:j][go]] = label[i:j][go]
                back[stop[i:j][go]] = begin[i:j][go]
        # The accepted path of each word, from its end.
        here, who, steps = at + length, np.arange(len(words)), []
        while len(who := who[here[who] != at[who]]):
            steps.append((who, state[here[who]]))
            here[who] = back[here[who]]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        who, ids = (np.concatenate(x) for x in zip(*reversed(steps)))
        return ids[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(words))


class Codec:
    """Encodes and decodes texts as a byte-level BPE tokenizer file with word ends says."""

    def __init__(self, spec: dict):
        import regex

        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in [*model["vocab"].items(), *self.special.items()]}
        self.label_array = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.string())
        kinds = {n["type"]: n for n in spec["normalizer"]["normalizers"]}
        if set(kinds) != {"NFC", "Replace", "Lowercase"} or spec["decoder"] is not None:
            raise ValueError("a tokenizer of another kind")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # The same pattern with the classes of the tokenizer's own Unicode version.
        letters, numbers = rf"[\p{{L}}--[{LATER_LETTERS}]]", rf"[\p{{N}}--[{LATER_NUMBERS}]]"
        if pattern != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            raise ValueError("a tokenizer of another pattern")
        self.pattern = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letters}+|{numbers}|[^\s{letters}{numbers}]+")
        self.mark = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.hint = min((s[:2] for s in self.special), default=None)
        self.decimal_array = pa.array(range(len(self.label_array)), pa.int32()).cast(pa.string())
        self.forget()

    def forget(self) -> None:
        """Empty the table of words: each word's row, the ids of all rows one after the other, and where they begin."""
        self.kept: dict[str, int] = {}
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def words(self, chunk: str) -> list[str]:
        """The words of a piece without ASCII white space; special tokens, found in the text as it is, are words too."""
        if self.mark is not None and self.hint in chunk:
            out, at = [], 0
            for m in self.mark.finditer(chunk):
                out += [*self.plain(chunk[at : m.start()]), m[0]]
                at = m.end()
            return out + self.plain(chunk[at:])
        return self.plain(chunk)

    def plain(self, chunk: str) -> list[str]:
        low = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).translate(CAPITALS).lower()
        return self.pattern.findall(low)

    def split(self, chunks: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """(words of all chunks one after the other, words in each): Latin letters with one mark behind at most, as
        nearly all chunks are, by whole columns; the others one by one."""
        simple = pc.match_substring_regex(chunks, SIMPLE)
        low = pc.utf8_lower(chunks.filter(simple))
        body = pc.utf8_rtrim(low, characters=MARKS)
        marked = pc.not_equal(pc.binary_length(body), pc.binary_length(low))
        marks = pc.utf8_slice_codeunits(low.filter(marked), -1)
        others = [self.words(c) for c in chunks.filter(pc.invert(simple)).to_pylist()]
        words = pa.concat_arrays([body, marks, pa.array([w for c in others for w in c], pa.string())]).dictionary_encode()
        # The words' places: a body comes first in its chunk, its mark second.
        mask, more = (x.to_numpy(zero_copy_only=False) for x in (simple, marked))
        per = np.zeros(len(chunks), dtype=np.int64)
        per[mask], per[~mask] = 1 + more, [len(c) for c in others]
        first = np.cumsum(per) - per
        place = np.concatenate((first[mask], first[mask][more] + 1, ranges(first[~mask], per[~mask])))
        codes = np.empty(len(place), dtype=np.int32)
        codes[place] = words.indices.to_numpy(zero_copy_only=False)
        return pa.DictionaryArray.from_arrays(pa.array(codes), words.dictionary), per

    def learn(self, words: list[str]) -> None:
        """Encode words and keep what comes out."""
        ids, count = [self.ids], [np.diff(self.first)]
        for group in groups(words):
            for special in [w for w in group if w in self.special]:
                group.remove(special)
                ids.append(np.array([self.special[special]], np.int32))
                count.append(np.ones(1, np.int64))
                self.kept[special] = len(self.kept)
            self.kept |= zip(group, range(len(self.kept), len(self.kept) + len(group)))
            found = self.automaton.encode([w.encode() for w in group])
            ids.append(found[0].astype(np.int32))
            count.append(found[1])
        self.ids, self.first = np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(count))))

    def encode_texts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin and the last's end), null taken as empty."""
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        seen = chunks.flatten().dictionary_encode()
        words, per = self.split(seen.dictionary)  # white space at either end leaves an empty chunk, without words
        if len(self.kept) > KEPT:
            self.forget()
        distinct = words.dictionary.to_pylist()
        if new := [w for w in distinct if w not in self.kept]:
            self.learn(new)
        row = np.fromiter(map(self.kept.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy(zero_copy_only=False)]
        # The ids of each distinct chunk, then of all chunks in text order.
        count = np.diff(self.first)[row]
        ids = self.ids[ranges(self.first[row], count)]
        size = np.diff(np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(per)))])
        index = seen.indices.to_numpy(zero_copy_only=False)
        all_ids = ids[ranges((np.cumsum(size) - size)[index], size[index])]
        ends = np.concatenate(([0], np.cumsum(size[index])))
        return all_ids, ends[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]

    def encode_long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for one text, read in pieces of about RUN characters that end at white space, where no token goes on."""
        parts, at = [], 0
        while at < len(text):
            gap = GAP.search(text, at + RUN)
            end = gap.start() if gap else len(text)
            parts.append(self.encode_texts(pa.array([text[at:end]], pa.string()))[0])
            at = end
        ids = np.concatenate(parts)
        return ids, np.array([0, len(ids)])

    def joined(self, ids: np.ndarray, ends: np.ndarray, labels: bool = False) -> pa.Array:
        """The decimal ids of each text, or its labels, joined by spaces: without a decoder, that is the decoded text."""
        names = self.label_array if labels else self.decimal_array
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(ids))), " ")

    def encode(self, text: str | None) -> list[int]:
        return self.encode_texts(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Arc labels, joined by spaces as without a decoder."""
        return " ".join(self.label_array.take(pa.array(ids, pa.int64())).to_pylist())


def groups(words: list[str]) -> Iterator[list[str]]:
    """Words in groups of about GROUP characters; a longer word is a group of its own."""
    out, size = [], 0
    for w in words:
        if out and size + len(w) > GROUP:
            yield out
            out, size = [], 0
        out.append(w)
        size += len(w)
    if out:
        yield out


def codec(path: str | None = None) -> Codec:
    """The codec of a tokenizer file, compiled once a process; by default the public one of 49,408 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _CODECS:
        with open(path, encoding="utf-8") as f:
            _CODECS[path] = Codec(json.load(f))
    return _CODECS[path]


_CODECS: dict[str, Codec] = {}


def digest(strings: pa.Array) -> pa.Array:
    return pa.array([sha256(s.as_buffer()).hexdigest() for s in strings], pa.string())


def run(docs: DataFrame, path: str | None, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """doc_id and, for each document, columns (type, function of the codec, all ids and where each document's begin)."""
    rows = picked(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        c = codec(path)
        for b in text_runs(batches, 1, RUN):
            texts = b.column(1).cast(pa.string())
            text = texts[0].as_py() if len(texts) == 1 else None
            done = c.encode_long(text) if text and len(text) > RUN else c.encode_texts(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), *(f(c, *done) for _, f in columns.values())], names=["doc_id", *columns])

    return rows.mapInArrow(encode, f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, (t, _) in columns.items()))


N_TOKENS = {"n_tokens": ("long", lambda c, ids, ends: pa.array(np.diff(ends), pa.int64()))}
IDS = {"ids": ("array<int>", lambda c, ids, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))}
IDS_SHA256 = {"ids_sha256": ("string", lambda c, ids, ends: digest(c.joined(ids, ends)))}
DECODED = {"decoded": ("string", lambda c, ids, ends: c.joined(ids, ends, labels=True))}
DECODED_SHA256 = {"decoded_sha256": ("string", lambda c, ids, ends: digest(c.joined(ids, ends, labels=True)))}


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, ids_sha256) for each document."""
    return run(docs, path, N_TOKENS | IDS | IDS_SHA256)


def decoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, decoded, decoded_sha256) for each document: its ids, decoded again."""
    return run(docs, path, N_TOKENS | DECODED | DECODED_SHA256)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each document."""
    return run(docs, path, N_TOKENS | IDS_SHA256 | DECODED_SHA256)
