"""Token counts that follow edits: a segment tree over pre-tokens per document.

A byte-level BPE encodes each pre-token by itself, so a text's count is the sum over its pre-tokens.
``LEAF`` pre-tokens make a leaf with its length in code points and its token count, and inner nodes
hold the sums of their two children, level by level. An edit replaces a span of code points. Cutting
restarts at the leaf that holds the second code point before the edit, as a pre-token depends on
nothing before it and on two code points after it at most, and goes on until a cut falls on an old
leaf border behind the edit; leaves from there on are as they were. Only the pre-tokens between are encoded, and only
the sums above changed leaves are added up again.

The state is a table: ``text`` and ``tree`` beside the columns of the documents. Texts are counted
where they lie; edits are joined by id. Null texts are empty; spans are clipped to the text, and null
edits change nothing. Several edits of a document apply in order of ``seq`` to the text that the ones
before left. Rows with equal ids get the same edits. Further columns are kept; the columns named
here replace others of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from textprep.llm.common import packed, quoted, sliced, unpacked
from textprep.llm.tokens import Encoder, default_path

LEAF = 32
TREE = "struct<chars: array<int>, tokens: array<int>>"
EDIT = "struct<seq: long, start: long, removed: long, inserted: string>"


class Counter:
    """Leaves of texts. Ids of a joined run of pre-tokens are those of the text they make up."""

    def __init__(self, path: str) -> None:
        self.encoder = Encoder(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def tokens(self, text: str) -> int:
        return len(self.encoder.encode(text))

    def leaf_tokens(self, text: str, borders: Sequence[int]) -> list[int]:
        """Counts of the leaves between borders.

        A leaf is encoded by itself. Its last pre-token may be a run of spaces that would be cut
        otherwise at the end of a text; so borders never follow white space.
        """
        return [self.tokens(text[a:b]) for a, b in zip(borders, borders[1:])]

    def borders(self, text: str, start: int, old: set[int] | None = None) -> list[int]:
        """Leaf borders from ``start`` on, up to the first one in ``old`` or the end of the text."""
        found, count = [start], 0
        for match in self.pattern.finditer(text, start):
            count += 1
            at = match.end()
            if text[at - 1].isspace():
                continue
            if old is not None and at in old:
                return found if found[-1] == at else [*found, at]
            if count >= LEAF:
                found.append(at)
                count = 0
        if found[-1] != len(text):
            found.append(len(text))
        return found


def levels(counts: Sequence[int]) -> list[list[int]]:
    """Sums of a binary tree, from the leaves to the root."""
    found = [list(counts)]
    while len(found[-1]) > 1:
        below = found[-1]
        found.append([sum(below[i : i + 2]) for i in range(0, len(below), 2)])
    return found


class Tree:
    """Lengths and counts of the leaves, with sums above both."""

    def __init__(self, chars: Sequence[int], tokens: Sequence[int]) -> None:
        self.chars, self.tokens = levels(chars), levels(tokens)

    @property
    def total(self) -> int:
        return self.tokens[-1][0] if self.tokens[0] else 0

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a code point, and where that leaf starts: a walk from the root."""
        node = start = 0
        for level in reversed(self.chars[:-1]):
            node *= 2
            if node + 1 < len(level) and place >= start + level[node]:
                start += level[node]
                node += 1
        return node, start

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Put new leaves in place of ``first`` to ``last - 1`` and renew the sums above them."""
        for sums, new in ((self.chars, chars), (self.tokens, tokens)):
            moved = len(new) != last - first
            sums[0][first:last] = new
            low, high = first, len(sums[0]) if moved else last
            depth = 0
            while len(sums[depth]) > 1:
                below, depth = sums[depth], depth + 1
                if depth == len(sums):
                    sums.append([])
                low, high = low // 2, -(-high // 2)
                fresh = [sum(below[2 * i : 2 * i + 2]) for i in range(low, high)]
                sums[depth] = sums[depth][:low] + fresh + ([] if moved else sums[depth][high:])
            del sums[depth + 1 :]


def build(counter: Counter, text: str) -> tuple[list[int], list[int]]:
    borders = counter.borders(text, 0) if text else [0]
    return [b - a for a, b in zip(borders, borders[1:])], counter.leaf_tokens(text, borders)


def edit(counter: Counter, text: str, tree: Tree, start: int, removed: int, inserted: str):
    """The text after one edit, and how many code points were encoded; ``tree`` is renewed."""
    start = min(max(start, 0), len(text))
    end = min(start + max(removed, 0), len(text))
    new = text[:start] + inserted + text[end:]
    if not tree.chars[0]:
        chars, tokens = build(counter, new)
        tree.chars, tree.tokens = levels(chars), levels(tokens)
        return new, len(new)
    first, at = tree.find(max(start - 2, 0))
    # Old borders behind the edit, as places of the new text, with the leaf that begins there.
    after, border, old = first, at, {}
    while after < len(tree.chars[0]):
        if border > end:
            old[border + len(inserted) - (end - start)] = after
        border += tree.chars[0][after]
        after += 1
    found = counter.borders(new, at, set(old)) if len(new) > at else [at]
    last = old.get(found[-1], len(tree.chars[0]))
    lengths = [b - a for a, b in zip(found, found[1:])]
    tree.replace(first, last, lengths, counter.leaf_tokens(new, found))
    return new, found[-1] - at


def per_row(df: DataFrame, columns: Sequence[str], more: str, rows_of) -> DataFrame:
    """``df``'s struct ``doc`` with new fields; ``rows_of`` makes them from lists of ``columns``."""
    schema = T.StructType([df.schema["doc"], *T.StructType.fromDDL(more).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = rows_of()
        for batch in sliced(batches, 250):
            values = [batch.column(c).to_pylist() for c in columns]
            rows = [make(*row) for row in zip(*values)]
            fields = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *fields], schema.names)

    types = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
    return df.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``tree`` (leaf lengths and counts) and ``n_tokens``."""
    path = path or default_path()

    def rows_of():
        counter = Counter(path)

        def make(value):
            chars, tokens = build(counter, value or "")
            return {"chars": chars, "tokens": tokens}, sum(tokens)

        return make

    out = per_row(packed(docs, value=text), ["value"], f"tree {TREE}, n_tokens long", rows_of)
    return unpacked(out, docs.columns, tree=F.col("tree"), n_tokens=F.col("n_tokens"))


def apply_edits(
    state: DataFrame, edits: Column | str, text: str = "text", path: str | None = None
) -> DataFrame:
    """The state after the edits of each row, an array of ``seq, start, removed, inserted``.

    Replaces ``text``, ``tree`` and ``n_tokens``, and adds ``n_encoded``, the code points encoded.
    Store the state of a large corpus before it is edited; it is what later edits start from.
    """
    path = path or default_path()

    def rows_of():
        counter = Counter(path)

        def make(value, old, todo):
            value, encoded = value or "", 0
            tree = Tree(old["chars"], old["tokens"])
            for x in sorted(todo or [], key=lambda x: x["seq"] or 0):
                if x["start"] is not None and x["removed"] is not None:
                    change = x["start"], x["removed"], x["inserted"] or ""
                    value, more = edit(counter, value, tree, *change)
                    encoded += more
            leaves = {"chars": tree.chars[0], "tokens": tree.tokens[0]}
            return value, leaves, tree.total, encoded

        return make

    if isinstance(edits, str):
        edits = F.col(quoted(edits))
    others = [c for c in state.columns if c not in (text, "tree", "n_tokens", "n_encoded")]
    out = packed(
        state, others or None, value=text, old="tree", todo=edits.cast(f"array<{EDIT}>")
    )
    fields = f"value string, tree {TREE}, n_tokens long, n_encoded long"
    out = per_row(out, ["value", "old", "todo"], fields, rows_of)
    new = {c: F.col(c) for c in ("tree", "n_tokens", "n_encoded")}
    return unpacked(out, others, **{text: F.col("value")}, **new)


def with_edits(state: DataFrame, edits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``state`` with the array column ``edits`` from rows ``doc_id, seq, start, removed, inserted``."""
    lists = edits.groupBy(F.col(quoted(doc_id)).alias("edited_id")).agg(
        F.collect_list(F.struct("seq", "start", "removed", "inserted")).alias("edits")
    )
    out = packed(state, id=doc_id).join(lists, F.col("id").eqNullSafe(F.col("edited_id")), "left")
    return unpacked(out, state.columns, edits=F.col("edits"))
