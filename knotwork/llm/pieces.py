"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model is compiled into machines that are composed with each text as the search goes:

* the normaliser (``normaliser.py``) rewrites the spellings of the model's character map and its
  blanks; the identity one is the machine that passes everything through;
* the lexicon, a trie, reads characters and writes pieces, and where a character is no piece, the
  byte pieces of its UTF-8 form;
* the pair acceptor weighs neighbouring pieces. For a byte-pair model a pair weighs 0 if merging
  the two pieces' characters by rank gives just these two, and infinity otherwise; for a unigram
  model a piece weighs its negated score and pairs weigh nothing.

The ids are the outputs of the shortest path in the
tropical semiring. In a byte-pair model all weights are 0 or infinity, a string has exactly one
path of finite weight, its encoding, and so has every prefix: the first path found is the
shortest, and a position from which none goes on is never tried again.

No piece crosses a place where a blank mark follows another character, or a character that
occurs in no longer piece. Texts are cut there, which is exact, and the paths of recent cuts are
kept in a bounded table in each worker.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .normaliser import Normaliser, spellings

BLANK = "▁"
INF = float("inf")
#: Cuts whose paths a worker keeps.
KEPT = 300_000


def load(path: str) -> dict:
    """Model file -> plain dictionary; read on the driver only."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        data = f.read()
    proto = pb.ModelProto.FromString(data)
    p = SentencePieceProcessor(model_proto=data)
    if proto.trainer_spec.treat_whitespace_as_suffix or not proto.normalizer_spec.escape_whitespaces:
        raise ValueError("only models that mark blanks in front of words can be compiled")
    if any(x.type == x.USER_DEFINED for x in proto.pieces):
        raise ValueError("models with user-defined symbols can't be compiled")
    kinds = proto.trainer_spec.ModelType
    if proto.trainer_spec.model_type not in (kinds.BPE, kinds.UNIGRAM):
        raise ValueError("only byte-pair and unigram models can be compiled")
    n = range(p.get_piece_size())
    return {
        "kind": "bpe" if proto.trainer_spec.model_type == kinds.BPE else "unigram",
        "prefix": bool(proto.normalizer_spec.add_dummy_prefix),
        "pieces": {p.id_to_piece(i): (i, p.get_score(i)) for i in n if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))},
        "bytes": {int(p.id_to_piece(i)[3:5], 16): i for i in n if p.is_byte(i)},
        "unknown": p.unk_id(),
        "spellings": spellings(proto.normalizer_spec.precompiled_charsmap),
        "squeeze": bool(proto.normalizer_spec.remove_extra_whitespaces),
    }


class Transducer(dict):
    """The compiled model; as a dictionary it maps a cut of a normalised text to its ids."""

    def __init__(self, model: dict):
        super().__init__()
        self.kind, self.prefix, self.pieces, self.bytes, self.unknown = (model[k] for k in ("kind", "prefix", "pieces", "bytes", "unknown"))
        rules, squeeze = model.get("spellings", {}), model.get("squeeze", False)
        self.normalise = Normaliser(rules, squeeze) if rules or squeeze else None
        self.leading = self.prefix or squeeze
        self.pairs: dict[int, bool] = {}
        self.names = {i: p for p, (i, _) in self.pieces.items()}
        self.trie: dict = {}
        for p, (i, _) in self.pieces.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        joined = {c for p in self.pieces if len(p) > 1 for c in p} - {BLANK}
        crossing = any(BLANK in p.lstrip(BLANK) for p in self.pieces)
        some = "".join(map(re.escape, sorted(joined)))
        if crossing or not some:
            self.cuts = re.compile(r"(?s).+")
        else:
            self.cuts = re.compile(f"(?s){BLANK}*[{some}]+|{BLANK}+|[^{some}{BLANK}]")
        #: A line feed that no longer piece holds, with cuts at blank marks, lets words be looked up whole.
        self.by_word = not crossing and "\n" not in joined and bool(some)
        self.after_blank = Words(self, BLANK)
        self.bare = Words(self, "")
        self.worst = min((s for _, s in self.pieces.values()), default=0.0) - 10
        self.spell = {i: p.replace(BLANK, " ").encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()} | {self.unknown: " ⁇ ".encode()}

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging by rank, leftmost first among equals; of two pieces' characters only."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.pieces.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: int, right: int) -> bool:
        """Whether the pair acceptor weighs two neighbouring pieces 0, not infinity; -1: the start."""
        if len(self.pairs) > 2 * KEPT:
            self.pairs.clear()
        a, b = self.names[left] if left >= 0 else "", self.names[right]
        self.pairs[left << 20 | right] = found = self.merge(a + b) == ([a, b] if a else [b])
        return found

    def arcs(self, cut: str, at: int) -> list[tuple[int, int]]:
        """Lexicon arcs (id or None, end) from a position, shortest first."""
        node, out = self.trie, []
        for end in range(at, len(cut)):
            node = node.get(cut[end])
            if node is None:
                break
            if "" in node:
                out.append((node[""], end + 1))
        return out if out and out[0][1] == at + 1 else [(None, at + 1), *out]

    def path(self, cut: str) -> list[tuple[int | None, int]]:
        """Arcs of the shortest path through a cut."""
        return self._only(cut) if self.kind == "bpe" else self._best(cut)

    def _only(self, cut: str) -> list[tuple[int | None, int]]:
        """The path of weight 0: arcs are tried longest first, and a position that failed is never met again."""
        out: list[tuple[int | None, int]] = []
        waiting, dead, pairs, n = [self.arcs(cut, 0)], set(), self.pairs, len(cut)
        at, last = 0, -1
        while at < n:
            arcs = waiting[-1]
            while arcs:
                piece, end = arcs.pop()
                if end in dead:
                    continue
                if piece is not None and last is not None:
                    fits = pairs.get(last << 20 | piece)
                    if not (self.apart(last, piece) if fits is None else fits):
                        continue
                out.append((piece, end))
                waiting.append(self.arcs(cut, end))
                at, last = end, piece
                break
            else:
                dead.add(at)
                waiting.pop()
                out.pop()
                last, at = out[-1] if out else (-1, 0)
        return out

    def _best(self, cut: str) -> list[tuple[int | None, int]]:
        cost, back = [0.0] + [INF] * len(cut), [None] * (len(cut) + 1)
        for at in range(len(cut)):
            for piece, end in self.arcs(cut, at):
                c = cost[at] - (self.pieces[self.names[piece]][1] if piece is not None else self.worst)
                if c < cost[end]:
                    cost[end], back[end] = c, (piece, at)
        out, end = [], len(cut)
        while end:
            piece, at = back[end]
            out.append((piece, end))
            end = at
        return out[::-1]

    def __missing__(self, cut: str) -> tuple[int, ...]:
        if len(self) > KEPT:
            self.clear()
        self[cut] = out = self.ids(cut)
        return out

    def ids(self, cut: str) -> tuple[int, ...]:
        ids: list[int] = []
        for piece, end in self.path(cut):
            if piece is not None:
                ids.append(piece)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in cut[end - 1].encode())
            else:
                ids.append(self.unknown)
        return tuple(ids)

    def encode(self, text: str) -> array:
        if text and self.normalise is not None:
            normal = self.normalise(text)
            text = normal if normal or self.normalise.squeeze else BLANK * self.prefix
            if text and normal:
                text = " " + text if self.prefix else text
        elif text and self.prefix:
            text = " " + text
        if not text:
            return array("i")
        out = self._pieces(text)
        if self.bytes:
            return out
        return array("i", [x for k, x in enumerate(out) if x != self.unknown or not k or out[k - 1] != x])

    def _pieces(self, text: str) -> array:
        if not self.by_word or BLANK in text:
            return self._cut(text)
        out = array("i")
        for n, line in enumerate(text.split("\n")):
            if n:
                out.extend(self.bare["\n"])
            words = line.split(" ")
            if "" in words[1:]:
                out.extend(self._cut(line))
            else:
                out.extend(self.bare[words[0]])
                out.extend(chain.from_iterable(map(self.after_blank.__getitem__, words[1:])))
        return out

    def _cut(self, text: str) -> array:
        return array("i", chain.from_iterable(map(self.__getitem__, self.cuts.findall(text.replace(" ", BLANK)))))

    def decode(self, ids) -> str:
        text = b"".join(map(self.spell.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.leading and text.startswith(" ") else text


class Words(dict):
    """Ids of words without blanks, after a given beginning."""

    def __init__(self, transducer: Transducer, before: str):
        super().__init__()
        self.transducer, self.before = transducer, before
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > KEPT // 2:  # what isn't met again in this half leaves with the next
            self.older = dict(self)
            self.clear()
        out = self.older.get(word)
        if out is None:
            t = self.transducer
            out = tuple(chain.from_iterable(map(t.ids, t.cuts.findall(self.before + word))))
        self[word] = out
        return out


_TRANSDUCERS: dict[int, Transducer] = {}


def _transducer(sent) -> Transducer:
    """One transducer is kept in each worker."""
    if sent.id not in _TRANSDUCERS:
        _TRANSDUCERS.clear()
        _TRANSDUCERS[sent.id] = Transducer(sent.value)
    return _TRANSDUCERS[sent.id]


class _Sent:
    """A broadcast model with a name that workers can compare."""

    def __init__(self, spark, model: dict):
        self.shared = spark.sparkContext.broadcast(model)
        self.id = hash((model["kind"], model["prefix"], tuple(model["pieces"].items()), tuple(model["spellings"].items()), model["squeeze"]))

    @property
    def value(self):
        return self.shared.value


def encode(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, ids array<int>).

    A null text counts as empty and has no ids; a blank mark in a text reads as a blank, as in
    the model's own library. Characters in a row that no piece covers are one unknown id in a
    model without byte pieces. Whole texts are encoded. Repeated rows are encoded each, an empty
    table gives no rows, other columns are not read.
    """
    small_batches(docs.sparkSession)
    sent = _Sent(docs.sparkSession, model)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        t = _transducer(sent)
        for b in batches:
            all_ids, ends = array("i"), [0]
            for x in b.column("text").to_pylist():
                all_ids += t.encode(x or "")
                ends.append(len(all_ids))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(all_ids, np.int32) if all_ids else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: dict) -> DataFrame:
    """(id, ids) -> (id, ids, text); null ids give an empty text."""
    small_batches(encoded.sparkSession)
    sent = _Sent(encoded.sparkSession, model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = _transducer(sent)
        for b in batches:
            flat, text = b.column("ids"), []
            for x in flat:
                text.append(t.decode(x.values.to_numpy().tolist() if x.is_valid else ()))
            yield pa.RecordBatch.from_arrays([b.column("id"), flat, pa.array(text, pa.string())], names=["id", "ids", "text"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, ids array<int>, text string")
