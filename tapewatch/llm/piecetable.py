"""SentencePiece encoding and decoding with a table of last tokens.

The encoder never merges anything. For each prefix of a stretch of text it
stores the prefix's last token. An Aho-Corasick automaton over the pieces
gives every piece that ends at the prefix's end; of these, exactly one is
compatible with the last token of the prefix before it, where two tokens are
compatible if merging their joined text gives the same two tokens. The ids are
then read off backwards.

A pair is tested on the two merge trees alone: the tokens at the border pass
through the right edge of the left tree and the left edge of the right one,
in the order of merge ranks, and the pair is compatible if no merge across the
border ever comes first.

Pieces hold white space only at their front, so a text falls into stretches
(a run of spaces and what follows it) that are encoded by themselves; tasks
keep a bounded table of the stretches they have met.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import hold, lean, with_columns

SPACE = "▁"
TABLE_BYTES = 48 << 20  # of stretches a worker keeps in a generation, beside as much of the one before
PAIRS = 300_000  # tested pairs kept, about 40 MB; then they are tested anew
ENTRY = 200  # bytes of an entry beside its characters
_STRETCH = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
NORMAL, BYTE = 1, 6  # kinds of pieces in a model file
OUTPUTS = {
    "ids": "array<int>",
    "n_tokens": "bigint",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


class PieceTable:
    """Encoder and decoder for one merge-type model with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("needs a merge-type model without text normalisation")
        self.prefix = norm.add_dummy_prefix
        self.piece = [p.piece for p in model.pieces]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.hidden = {i for i, p in enumerate(model.pieces) if p.type not in (NORMAL, BYTE)}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.rank = [-p.score for p in model.pieces]
        inner = [p for p in self.id if SPACE in p.lstrip(SPACE) or "\n" in p]
        strange = [p for p in self.id if any(c not in self.id for c in p)]
        if inner or strange:
            raise ValueError(f"pieces that do not fit the stretches: {(inner + strange)[:5]}")
        self.split = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            tree = self._merge(p)
            if isinstance(tree, int):  # else merging its text gives other tokens: it never occurs
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.chars = frozenset(p for p in self.id if len(p) == 1)
        self.pairs: dict[int, bool] = {}
        # stretch: its ids, each with a comma behind; those that decode to other text than their own are in ``odd``
        self.known: dict[str, str] = {}
        self.before: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.bytes = 0

    def _merge(self, text: str):
        """The token a piece's text merges to, noting its last merge, or None."""
        parts = [self.id[c] for c in text]
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                z = self.id.get(self.piece[parts[k]] + self.piece[parts[k + 1]])
                if z is not None and (best is None or self.rank[z] < self.rank[best[0]]):
                    best = (z, k)
            if best is None:
                return None
            z, k = best
            self.split.setdefault(z, (parts[k], parts[k + 1]))
            parts[k : k + 2] = [z]
        return parts[0]

    def _edge(self, token: int, side: int) -> list[int]:
        """Tokens at one edge of a token's merge tree, from a single character up."""
        path = [token]
        while path[-1] in self.split:
            path.append(self.split[path[-1]][side])
        return path[::-1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether two tokens may stand side by side; noted in ``pairs``."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[a << 32 | b] = self._test(a, b)
        return found

    def _test(self, a: int, b: int) -> bool:
        xs, ys, never = self._edge(a, 1), self._edge(b, 0), float("inf")
        i = j = 0
        while True:
            nx = self.rank[xs[i + 1]] if i + 1 < len(xs) else never
            ny = self.rank[ys[j + 1]] if j + 1 < len(ys) else never
            z = self.id.get(self.piece[xs[i]] + self.piece[ys[j]])
            if z is not None and self.rank[z] < nx and self.rank[z] <= ny:
                return False
            if nx == never and ny == never:
                return True
            if nx <= ny:
                i += 1
            else:
                j += 1

    def encode_stretch(self, text: str) -> list[int]:
        """Ids of text in which spaces are already replaced."""
        if self.chars.issuperset(text):
            return self._encode_run(text)
        out: list[int] = []
        run: list[str] = []
        for c in text:
            if c in self.chars:
                run.append(c)
                continue
            out += self._encode_run("".join(run))
            run = []
            out += [self.byte_id[x] for x in c.encode("utf-8")]
        return out + self._encode_run("".join(run))

    def _encode_run(self, text: str) -> list[int]:
        if not text:
            return []
        # the last token of every prefix, -1 while it is not known, and its length
        last, width = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        known, test = self.pairs.get, self.compatible
        for end, (token, size) in self.automaton.iter(text):
            at = end + 1
            if last[at] >= 0:
                continue
            if at != size:
                before = last[at - size]
                if before < 0:
                    continue
                fits = known(before << 32 | token)
                if fits is None:
                    fits = test(before, token)
                if not fits:
                    continue
            last[at], width[at] = token, size
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= width[at]
        return ids[::-1]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; ``first``: they begin a text, so one leading space is the model's own."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.id_byte:
                raw.append(self.id_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.hidden:
                out.append(self.piece[i].replace(SPACE, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if first and self.prefix and text[:1] == " " else text

    def stretch(self, text: str) -> str:
        """Ids of one stretch as text."""
        found = self.known.get(text)
        if found is None:
            if self.bytes > TABLE_BYTES:
                self.known, self.before, self.bytes = {}, self.known, 0
                self.odd = {k: v for k, v in self.odd.items() if k in self.before}
            found = self.before.get(text)
            if found is None:
                ids = self.encode_stretch(text)
                found = ",".join(map(str, ids)) + ","
                back = self.decode(ids, first=False)
                if back != text.replace(SPACE, " "):
                    self.odd[text] = back
            self.bytes += ENTRY + len(found) + (len(text) if text.isascii() else 2 * len(text))
            self.known[text] = found
        return found

    def document(self, text: str) -> list[tuple[str, int, str]]:
        """A text's ids joined by commas, their number, and the text decoded from them with the model's own space in front; none if empty."""
        if not text:
            return []
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        known, make = self.known.get, self.stretch
        parts = _STRETCH.findall(text)
        ids = "".join([known(s) or make(s) for s in parts])[:-1]
        odd = self.odd
        if odd and not odd.keys().isdisjoint(parts):
            back = "".join([odd[s] if s in odd else s.replace(SPACE, " ") for s in parts])
        else:
            back = text.replace(SPACE, " ")
        return [(ids, ids.count(",") + 1, back)]


@lru_cache(maxsize=2)
def table(path: str) -> PieceTable:
    return PieceTable(path)


def _encode(path: str, at: int, outputs: list[str]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("piecetable", table.cache_clear)
        t = table(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                made: dict[str, list] = {c: [] for c in outputs}
                for text in part.column(at).to_pylist():
                    ids, n, back = t.document(text)[0] if text else ("", 0, "")
                    if t.prefix and back[:1] == " ":
                        back = back[1:]
                    if "n_tokens" in made:
                        made["n_tokens"].append(n)
                    if "ids" in made:
                        made["ids"].append(np.fromstring(ids, np.int32, sep=",") if ids else [])
                    if "ids_sha256" in made:
                        made["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    if "decoded" in made:
                        made["decoded"].append(back)
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                cols = {c: part.column(i) for i, c in enumerate(part.schema.names) if c not in made}
                kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
                for c in outputs:
                    cols[c] = pa.array(made[c], kinds.get(c, pa.string()))
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def sentencepiece_documents(docs: DataFrame, model: str, outputs: list[str], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the named outputs of encoding and decoding each whole text.

    ``outputs`` are of ``OUTPUTS``: the ids, their number, the text decoded
    from them, and SHA-256 digests of the ids (decimal, joined by commas) and
    of the decoded text. Columns of ``docs`` with these names are replaced.
    No begin or end ids are added. Null and empty texts have no ids and decode
    to the empty text. Rows are independent, so ties and repeats do not matter.
    """
    ddl = ", ".join(f"{c} {OUTPUTS[c]}" for c in outputs)
    return docs.mapInArrow(_encode(model, docs.columns.index(text_col), outputs), with_columns(docs, ddl))
