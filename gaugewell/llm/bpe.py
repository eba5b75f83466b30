"""BPE encoding and decoding by a tokenization automaton.

The automaton's states are the tokens (and the start); reading label t, a token, from
state s is an arc s -t-> t. It is compiled by successive merge gadgets: at first every pair
of single symbols has an arc; the gadget of the k-th merge (u, v) gives the new token uv an
arc from every state that has an arc u, gives the state uv the arcs of state v as they are
then, and removes the arc u -v-> with those of what was made of v. What remains after the
last gadget are the arcs of the one correct tokenization of each string. Labels are put in
an order in which those that begin with one another stand together, so that each removal
is one interval, and the new label has the arcs of the label u without being written
down: a state's row is the list of the intervals that it refuses. Rows (some 900,000
intervals for 49,000 tokens) and the moves along the labels' spellings are arrays.

A pre-split word is encoded by table-driven transitions from its first symbol on: from the
state after each prefix every label that the word spells there, and that the state's row
has, leads to the state after the longer prefix. Every prefix has one state; the labels
back from the last are the word's ids. Decoding emits the labels' texts, from the ids
alone.

Defined results: a null or empty text gives no tokens and an empty decoded text; rows
are answered one by one, so repeated rows and ids, ties and extra columns don't matter. A
text is held whole by one task, at some 100 bytes a character; a word of any length is run
by itself, in time that grows with its length.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import ChunkValues, bounded_batches, drops_space, few_at_once, lowers, read_tokenizer, texts_of


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + len(chars) - len(plain))
    return [chars[b] for b in range(256)]


class MergeAutomaton:
    """States are the tokens that end no word and the start; labels are all tokens.

    A state's row is the labels that it refuses, as intervals of the labels' order, in
    which the labels that begin with one another's parts stand together: ``row_at`` has
    where each state's row begins in ``low`` and ``high``. Words' symbols are read along
    the labels' spellings, a table of moves by node and class of symbols.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        size = max(vocab.values(), default=-1) + 1
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        left, right, birth = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        gadgets = []
        for k, merge in enumerate(merges):
            u, v = merge.split(" ") if isinstance(merge, str) else merge
            a, b, out = vocab[u], vocab[v], vocab[u + v]
            if birth[a] >= k or birth[b] >= k:
                raise ValueError("a merge comes before its parts")
            gadgets.append((a, b, out))
            if birth[out] < 0:
                left[out], right[out], birth[out] = a, b, k
        order, reach = self._label_order(left, birth, [b for _, b, _ in gadgets])
        self.position = order
        rows: dict[int, list[int]] = {}
        for k, (a, b, out) in enumerate(gadgets):  # the gadgets, in turn
            if birth[out] == k and b in rows:
                rows[out] = rows[b].copy()  # the new state has the arcs of the state b as they are now
            rows.setdefault(a, []).append(k)  # and then a loses its arc b, and what has been made of b
        self._compile_rows(rows, size, reach)

        # symbols: 0-255 a byte within a word, 256-511 a byte that ends it
        self.has_suffix = bool(suffix)
        self.length = np.zeros(size, dtype=np.int64)
        spelled = []
        for text, i in vocab.items():
            ends = bool(suffix) and text.endswith(suffix) and text != suffix
            body = text[: -len(suffix)] if ends else text
            if not body or not all(c in byte_of for c in body) or (birth[i] < 0 and len(body) > 1):
                continue  # no merge makes it
            symbols = [byte_of[c] for c in body]
            symbols[-1] += 256 * ends
            self.length[i] = len(symbols)
            spelled.append((symbols, i))
        self._compile_moves(spelled)

    @staticmethod
    def _label_order(left: np.ndarray, birth: np.ndarray, second: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The place of each label, after the label that it begins with and before those that were made of that one earlier; and for the k-th merge (a, b) the places [from, to) of b and of what was made of it from then on."""
        n = len(left)
        by_birth = np.argsort(birth, kind="stable")
        under = np.ones(n, dtype=np.int64)
        for t in by_birth[::-1].tolist():
            if left[t] >= 0:
                under[left[t]] += under[t]
        # children of a label, the latest first: a label's place is its parent's, one more, and the places under later siblings
        place = np.zeros(n, dtype=np.int64)
        later = np.zeros(n, dtype=np.int64)
        offset = np.zeros(n, dtype=np.int64)
        for t in by_birth[::-1].tolist():
            if left[t] >= 0:
                offset[t] = later[left[t]] + 1
                later[left[t]] += under[t]
        roots = 0
        for t in by_birth.tolist():
            if left[t] < 0:
                place[t] = roots
                roots += under[t]
            else:
                place[t] = place[left[t]] + offset[t]
        # going back in time, what is under a label from the k-th merge on
        since = np.zeros(n, dtype=np.int64)
        reach = np.zeros((len(second), 2), dtype=np.int64)
        made = {int(birth[t]): t for t in range(n) if birth[t] >= 0}
        for k in range(len(second) - 1, -1, -1):
            if k in made:
                since[left[made[k]]] += under[made[k]]
            reach[k] = place[second[k]], place[second[k]] + 1 + since[second[k]]
        return place, reach

    def _compile_rows(self, rows: dict[int, list[int]], size: int, reach: np.ndarray) -> None:
        """Of each state's intervals, which lie in one another or apart, those that no other holds."""
        states = np.repeat(np.array(list(rows), dtype=np.int64), [len(r) for r in rows.values()])
        at = reach[np.concatenate([np.array(r, dtype=np.int64) for r in rows.values()])] if rows else np.zeros((0, 2), dtype=np.int64)
        order = np.lexsort((-at[:, 1], at[:, 0], states))
        states, low, high = states[order], at[order, 0], at[order, 1]
        furthest = np.maximum.accumulate(states * size + high) if len(states) else high
        outer = np.ones(len(states), dtype=bool)
        outer[1:] = (states[1:] != states[:-1]) | (states[1:] * size + high[1:] > furthest[:-1])
        states, self.low, self.high = states[outer], low[outer].astype(np.int32), high[outer].astype(np.int32)
        self.row_at = np.searchsorted(states, np.arange(size + 1))
        self._size, self._keys = size, states * size + self.low

    def _compile_moves(self, spelled: list[tuple[list[int], int]]) -> None:
        """Nodes that lead on have the lowest numbers; the root's moves are apart, as it alone has one for every symbol."""
        nodes: dict[tuple[int, int], int] = {}
        label = [-1]
        for symbols, i in spelled:
            node = 0
            for s in symbols:
                node = nodes.setdefault((node, s), len(label))
                if node == len(label):
                    label.append(-1)
            label[node] = i
        from_, symbol, to = np.array([(n, s, t) for (n, s), t in nodes.items()], dtype=np.int64).reshape(-1, 3).T
        leads = np.zeros(len(label), dtype=bool)
        leads[from_] = leads[0] = True
        number = np.where(leads, np.cumsum(leads) - 1, leads.sum() + np.cumsum(~leads) - 1)
        self.inner = int(leads.sum())
        self.label_of = np.empty(len(label), dtype=np.int64)
        self.label_of[number] = label
        from_, to, top = number[from_], number[to], from_ == 0
        self.first_move = np.zeros(512, dtype=np.int64)
        self.first_move[symbol[top]] = to[top]
        used = np.unique(symbol[~top])
        self.width = len(used) + 1
        self.symbol_class = np.full(512, len(used), dtype=np.int64)
        self.symbol_class[used] = np.arange(len(used))
        #: By node and class; 0, where all words begin, is where no move leads.
        self.moves = np.zeros(self.inner * self.width, dtype=np.int32)
        self.moves[from_[~top] * self.width + self.symbol_class[symbol[~top]]] = to[~top]

    def arcs(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether each state has an arc of the label; the start (-1) has all."""
        place = self.position[labels]
        at = np.searchsorted(self._keys, states * self._size + place, side="right") - 1
        inside = (at >= 0) & (states >= 0)
        inside &= at >= self.row_at[states]
        return ~(inside & (place < self.high[at])) if len(self.high) else np.ones(len(states), dtype=bool)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and where each word's begin (one more entry than words). A word isn't empty."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        parts, counts, start = [], np.zeros(len(words), dtype=np.int64), 0
        while start < len(words):
            rows = order[start : start + max(1, min(50_000, 2_000_000 // int(sizes[order[start]])))]
            ids, n = self._run([words[k] for k in rows.tolist()], sizes[rows])
            counts[rows] = n
            parts.append(ids)
            start += len(rows)
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        begin = np.concatenate(([0], np.cumsum(counts[order])))[:-1]
        ends = np.concatenate(([0], np.cumsum(counts)))
        of_word = np.empty(len(words), dtype=np.int64)
        of_word[order] = begin
        return flat[np.repeat(of_word - ends[:-1], counts) + np.arange(len(flat))], ends

    def _run(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers, of words by falling length. state[i] is the state of each word after i symbols."""
        n, most = len(words), int(sizes[0])
        raw = np.zeros((n, most), dtype=np.int64)
        raw[np.arange(most) < sizes[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
        if self.has_suffix:
            raw[np.arange(n), sizes - 1] += 256
        symbols, raw = np.ascontiguousarray(self.symbol_class[raw].T), np.ascontiguousarray(raw.T)
        state = np.full((most + 1, n), -1, dtype=np.int64)
        longer = np.searchsorted(-sizes, -np.arange(most + 1), side="right")  # words of i symbols or more
        for i in range(most):
            rows, from_ = np.arange(longer[i + 1]), state[i]
            node = self.first_move[raw[i][rows]]
            for j in range(i, most):
                if j > i:
                    go = node < self.inner
                    if longer[j + 1] < longer[j]:
                        go &= rows < longer[j + 1]
                    rows, node = rows[go], node[go]
                    node = self.moves[node * self.width + symbols[j][rows]].astype(np.int64)
                some = node > 0
                rows, node = rows[some], node[some]
                if not len(rows):
                    break
                token = self.label_of[node]
                whole = np.flatnonzero(token >= 0)
                at, token = rows[whole], token[whole]
                good = self.arcs(from_[at], token)
                state[j + 1][at[good]] = token[good]
        # back from the end, by the labels' lengths
        at, rows, out, where = sizes.copy(), np.arange(n), [], []
        while len(rows):
            token = state[at[rows], rows]
            if (token < 0).any():
                raise ValueError("a symbol has no token")
            out.append(token)
            where.append(rows)
            at[rows] -= self.length[token]
            rows = rows[at[rows] > 0]
        number = np.bincount(np.concatenate(where), minlength=n)
        turn = np.repeat(np.arange(len(out)), [len(o) for o in out])
        return np.concatenate(out)[np.lexsort((-turn, np.concatenate(where)))], number


class BpeCodec:
    """Ids of whole texts as the tokenizer file has them, and texts of ids."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model = parsed["model"]
        if not drops_space(parsed) or model["type"] != "BPE" or model.get("continuing_subword_prefix"):
            raise ValueError("only byte-level BPE whose pre-tokenizer drops white space is supported")
        self.vocab = model["vocab"]
        self.automaton = MergeAutomaton(self.vocab, model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        labels = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.is_label = np.array([i in labels for i in range(max(labels, default=-1) + 1)], dtype=bool)
        self.label_texts = pa.array([labels.get(i, "") for i in range(len(self.is_label))], pa.large_string())
        first = parsed["pre_tokenizer"].get("pretokenizers", [parsed["pre_tokenizer"]])[0]
        self.pattern = regex.compile(first["pattern"]["Regex"])
        self.lower = lowers(parsed)
        self.words: dict[str, list[int]] = {}

    def _pieces(self, text: str) -> list:
        """Words to be encoded (str) and special ids (int) of a text."""
        if text.isascii() and text.isalpha():
            return [text.lower() if self.lower else text]
        out: list = []
        for p in self.cut.split(text) if self.cut else [text]:
            if p in self.special:
                out.append(self.special[p])
            elif p:
                p = unicodedata.normalize("NFC", p)
                if self.lower:
                    p = "".join(map(str.lower, p)) if "Σ" in p else p.lower()
                out += self.pattern.findall(p)
        return out

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        if len(self.words) > 200_000:
            self.words = {}
        pieces = [self._pieces(c) for c in chunks]
        new = list(set(itertools.chain.from_iterable(pieces)).difference(self.words).difference(self.special.values()))
        ids, ends = self.automaton.encode_words([w.encode() for w in new])
        ids, ends = ids.tolist(), ends.tolist()
        self.words.update(zip(new, [ids[a:b] for a, b in zip(ends, ends[1:])]))
        known = self.words
        return [known[p[0]] if len(p) == 1 and p[0] in known else [i for w in p for i in (known[w] if isinstance(w, str) else (w,))] for p in pieces]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """The labels' texts, as the library joins them, of many lists of ids: one after another, and where each begins (one more entry)."""
        if len(ids) and not self.is_label[ids].all():
            some = self.is_label[ids]
            ids, starts = ids[some], np.concatenate(([0], np.cumsum(some)))[starts]
        return joined(self.label_texts, ids, starts)


def joined(texts: pa.Array, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """texts of ids, joined by one space."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), texts.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


_CODECS: dict[str, tuple] = {}


def _codec(spec: str):
    """The codec, its chunk values and the decimal forms of ids, kept by the worker from task to task."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _CODECS:
        codec = BpeCodec(spec)
        values = ChunkValues(lambda chunks, known: [np.array(i, dtype="<u4").tobytes() for i in codec.encode_chunks(chunks)], codec.lower, list(codec.special), 250_000)
        _CODECS[key] = (codec, values, pa.array(list(map(str, range(len(codec.is_label)))), pa.large_string()))
    return _CODECS[key]


def _ids(values: ChunkValues, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts, one after another, and where each text's begin (one more entry than texts)."""
    some, which, starts = values(texts)
    flat = np.frombuffer(b"".join(some), dtype="<u4")
    sizes = np.array(list(map(len, some)), dtype=np.int64) // 4
    first = (np.cumsum(sizes) - sizes)[which]
    sizes = sizes[which]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return flat[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])], ends[starts]


def encode(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (unsigned 32-bit, little-endian), decoded (what the ids decode to)."""
    return _encoded(df, tokenizer, id_col, text_col, False)


def digest(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256."""
    return _encoded(df, tokenizer, id_col, text_col, True)


def _sha256(texts: pa.Array) -> pa.Array:
    """Of each text's UTF-8."""
    data, at = memoryview(texts.buffers()[2] or b""), np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string())


def _encoded(df, tokenizer, id_col, text_col, digests):
    bounded_batches(df.sparkSession)
    spec = read_tokenizer(tokenizer)

    def run(batches):
        codec, values, decimals = _codec(spec)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in few_at_once(texts, 1_000_000):
                ids, starts = _ids(values, texts[a:b])
                first = batch.column(0).slice(a, b - a)
                decoded = codec.decode(ids, starts)
                if digests:
                    columns = [first, pa.array(np.diff(starts)), _sha256(joined(decimals, ids, starts)), _sha256(decoded)]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    raw, at = ids.astype("<u4").tobytes(), (4 * starts).tolist()
                    yield pa.RecordBatch.from_arrays([first, pa.array([raw[i:j] for i, j in zip(at, at[1:])], pa.binary()), decoded.cast(pa.string())], names=[id_col, "ids", "decoded"])

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, {out}")
