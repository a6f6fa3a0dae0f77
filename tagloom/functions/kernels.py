"""Columnar kernels of the sequence functions (T04-T06, T14) over the flat buffers of Arrow lists.

A batch of rows is one flat array of labels, tokens or characters with row offsets.  Texts are code
points, labels and tokens are codes into their few distinct values, and every step is a prefix sum, a
gather or a comparison over the flat arrays.  A batch is worked on in slices of whole rows with about
``SLICE`` elements, so memory does not depend on the batch size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tagloom.constants import ALL_LABELS

SLICE = 1 << 20
UNK = "[UNK]"


# --- flat arrays -------------------------------------------------------------------------

def offsets(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def flat_list(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(values, row offsets) of a list column; a null row is empty."""
    return column.flatten(), offsets(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))


def encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes, distinct values); a null has code -1."""
    d = values if pa.types.is_dictionary(values.type) else values.dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def coded(values: pa.Array) -> tuple[np.ndarray, list]:
    """``encoded`` with the distinct values as a list."""
    codes, distinct = encoded(values)
    return codes, distinct.to_pylist()


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row offsets) of a text column; a null text is empty."""
    if not len(column):
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offs = offsets(pc.utf8_length(column).to_numpy(zero_copy_only=False))
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or at[0] == at[-1]:
        return np.empty(0, np.uint32), offs
    return np.frombuffer(str(memoryview(data)[at[0]:at[-1]], "utf-8").encode("utf-32-le"), np.uint32), offs


#: Of a byte: blank, letter, digit, other character, and one that goes on a character.
BLANK, LETTER, DIGIT, OTHER, GOES_ON = range(5)
KIND = np.full(256, OTHER, np.int8)
KIND[0x20], KIND[0x30:0x3A], KIND[0x80:0xC0] = BLANK, DIGIT, GOES_ON
KIND[0x41:0x5B] = KIND[0x61:0x7B] = LETTER


def pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces, row offsets): letter runs, digit runs and single other characters but the blank U+0020; a null text has none.

    Pieces are cut from the UTF-8 bytes: one begins where the kind of byte changes, at every other character, and at a row.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column) or not (size := int(pc.sum(pc.binary_length(column)).as_py())):
        return pa.array([], pa.large_string()), np.zeros(len(column) + 1, np.int64)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    data, at = data.slice(int(at[0]), size), at - at[0]
    kind = KIND[np.frombuffer(data, np.uint8)]
    begins = np.ones(size, bool)
    begins[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == OTHER)) & (kind[1:] != GOES_ON)
    begins[at[:-1][at[:-1] < size]] = True
    first = np.flatnonzero(begins)
    runs = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(first, size)), data)
    solid = kind[first] != BLANK
    return runs.filter(pa.array(solid)), np.concatenate([[0], np.cumsum(solid)])[np.searchsorted(first, at)]


def row_of(offs: np.ndarray) -> np.ndarray:
    """Row of every element."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def list_column(values: pa.Array, sizes: np.ndarray, nulls: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets(sizes), pa.int32()), values, mask=pa.array(nulls))


def pick(names: list, codes: np.ndarray) -> pa.Array:
    """Strings of codes, null for -1."""
    return pa.array(names, pa.string()).take(pa.array(codes, pa.int64(), mask=codes < 0)) if names else pa.nulls(len(codes), pa.string())


def named(names: list, codes: np.ndarray) -> pa.Array:
    """Codes with their names, null for -1: what one kernel hands to the next."""
    return pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32), pa.int32(), mask=codes < 0), pa.array(names, pa.string()))


def spelled(column: pa.Array) -> pa.Array:
    """A list column of names as a list column of strings; others stay."""
    if not (pa.types.is_list(column.type) and pa.types.is_dictionary(column.type.value_type)):
        return column
    values, at = flat_list(column)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values.cast(pa.string()), mask=column.is_null())


def any_null(*columns: pa.Array) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        out |= c.is_null().to_numpy(zero_copy_only=False)
    return out


def by_slices(run: Callable, *columns: pa.Array) -> pa.Array:
    """``run`` over slices of whole rows; rows where any column is null become empty rows first."""
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    weight = sum((pc.fill_null(pc.list_value_length(c) if pa.types.is_list(c.type) else pc.binary_length(c), 0)
                  .to_numpy(zero_copy_only=False).astype(np.int64) for c in columns), np.zeros(len(columns[0]), np.int64))
    reach, lo, parts = offsets(weight), 0, []
    while lo < len(weight):
        hi = max(lo + 1, int(np.searchsorted(reach, reach[lo] + SLICE, "right")) - 1)
        part = [c.slice(lo, hi - lo) for c in columns]
        nulls = any_null(*part)
        if nulls.any():
            rows = pa.array(np.arange(hi - lo), pa.int64(), mask=nulls)
            part = [c.take(rows) for c in part]
        parts.append(spelled(run(nulls, *part)))
        lo = hi
    return pa.concat_arrays(parts) if parts else spelled(run(np.zeros(0, bool), *columns))


# --- tokens ------------------------------------------------------------------------------

def token_table(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct tokens: (characters each covers, whether it goes on a word, their characters, offsets).

    ``##`` marks a piece that goes on a word and covers none; the unknown token covers one character, -1.
    """
    tokens = tokens.cast(pa.string())
    goes_on, unknown = pc.starts_with(tokens, "##"), pc.equal(tokens, UNK)
    points, at = code_points(pc.if_else(unknown, "?", pc.if_else(goes_on, pc.utf8_slice_codeunits(tokens, 2), tokens)))
    points = points.astype(np.int64)
    points[at[:-1][unknown.to_numpy(zero_copy_only=False)]] = -1
    return np.diff(at), goes_on.to_numpy(zero_copy_only=False), points, at


def inner_codes(names: list) -> tuple[list, np.ndarray]:
    """Label names with the inner forms they lack, and the code of each name's inner form."""
    names = list(names)
    place = {n: i for i, n in enumerate(names)}
    for n in list(names):
        if n.startswith("B"):
            if "I" + n[1:] not in place:
                place["I" + n[1:]] = len(names)
                names.append("I" + n[1:])
    return names, np.array([place["I" + n[1:]] if n.startswith("B") else i for i, n in enumerate(names)], np.int64)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the concatenated spans."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


# --- kernels -----------------------------------------------------------------------------

def align(nulls: np.ndarray, text: pa.Array, labels: pa.Array, tokens: pa.Array) -> pa.Array:
    """T03 + T04: the label of each token's first character, null past the labels."""
    points, text_at = code_points(text)
    codes, names = coded(flat_list(labels)[0])
    label_at = flat_list(labels)[1]
    words, token_at = flat_list(tokens)
    kinds, distinct = encoded(words)
    sizes = token_table(distinct)[0]

    # labels of characters other than blanks, in order: positions in the flat labels
    both = np.minimum(np.diff(text_at), np.diff(label_at))
    at = gather(text_at[:-1], both)
    solid = points[at] != 32
    kept = gather(label_at[:-1], both)[solid]
    kept_at = np.concatenate([[0], np.cumsum(solid)])[offsets(both)]

    start = offsets(sizes[kinds]) if len(kinds) else np.zeros(1, np.int64)
    row = row_of(token_at)
    place = start[:-1] - start[token_at[:-1]][row]               # characters before the token in its row
    found = place < np.diff(kept_at)[row]
    out = np.full(len(place), -1, np.int64)
    out[found] = codes[kept[kept_at[:-1][row[found]] + place[found]]]
    return list_column(named(names, out), np.diff(token_at), nulls)


def expand(nulls: np.ndarray, tokens: pa.Array, labels: pa.Array) -> pa.Array:
    """Token labels -> labels of the token text's characters.

    A word's head keeps its label on the first character; all else of the word gets the head's inner
    form.  A piece that goes on where no word began has no label.
    """
    words, token_at = flat_list(tokens)
    values, label_at = flat_list(labels)
    both = np.minimum(np.diff(token_at), np.diff(label_at))
    kinds, distinct = encoded(words)
    codes, names = coded(values)
    names, inner = inner_codes(names)
    sizes, goes_on, _, _ = token_table(distinct)
    kinds, codes = kinds[gather(token_at[:-1], both)], codes[gather(label_at[:-1], both)]
    row_at = offsets(both)
    piece = goes_on[kinds] if len(kinds) else np.zeros(0, bool)
    size = sizes[kinds] if len(kinds) else np.zeros(0, np.int64)
    size = np.where(piece, size, np.maximum(size, 1))

    here = np.arange(len(kinds))
    head = np.maximum.accumulate(np.where(piece, -1, here)) if len(here) else here
    known = head >= row_at[:-1][row_of(row_at)]
    rest = np.full(len(kinds), -1, np.int64)
    rest[known] = codes[head[known]]
    rest[rest >= 0] = inner[rest[rest >= 0]]
    out = np.repeat(rest, size)
    char_at = offsets(size)
    out[char_at[:-1][~piece]] = codes[~piece]
    return list_column(named(names, out), np.diff(char_at[row_at]), nulls)


def lowered(points: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function that maps these code points to one number for each lower-case form; -1 stays."""
    of = np.zeros(int(points.max(initial=0)) + 2, np.int32)       # -1 is the last place
    of[points] = 1
    number: dict[str, int] = {}
    for p in np.flatnonzero(of[:-1]).tolist():
        of[p] = number.setdefault(chr(p).lower(), len(number))
    of[-1] = -1
    return lambda x: of[x]


def meet(text: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Position in ``body`` that each character of ``text`` stands for, -1 for none, up to the end of ``body``.

    For tokenizers that drop characters: both go on side by side in windows that double while all
    agree; where they part, the text skips to the next character that agrees.
    """
    out, i, j, width = [], 0, 0, 64
    while i < len(text) and j < len(body):
        n = min(width, len(text) - i, len(body) - j)
        part = (text[i:i + n] != body[j:j + n]) & (body[j:j + n] >= 0)
        same = int(part.argmax()) if part.any() else n
        out.append(np.where(body[j:j + same] >= 0, np.arange(j, j + same), -1))
        i, j, width = i + same, j + same, 64 if same < n else 2 * width
        skipped, reach = 0, 64
        while same < n and i + skipped < len(text):
            hit = np.flatnonzero(text[i + skipped:i + skipped + reach] == body[j])
            if len(hit):
                skipped += int(hit[0])
                break
            skipped, reach = min(skipped + reach, len(text) - i), 2 * reach
        out.append(np.full(skipped, -1))
        i += skipped
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def realign(nulls: np.ndarray, text: pa.Array, tokens: pa.Array, labels: pa.Array) -> pa.Array:
    """Labels of the token text's characters, put back on the text's characters.

    The k-th character of the token text stands for the k-th character of the text that is not a blank.
    Blanks and unknown characters get ``O``.  The result ends where the token text does: at the character
    of its last known one, and one further for each unknown one after that.
    Rows where the characters do not agree, as the tokenizer drops some, are met run by run.
    """
    points, text_at = code_points(text)
    points = points.astype(np.int64)
    words, token_at = flat_list(tokens)
    values, label_at = flat_list(labels)
    codes, names = coded(values)
    outside = names.index("O") if "O" in names else len(names)
    names = names if "O" in names else [*names, "O"]
    kinds, distinct = encoded(words)
    sizes, _, chars, char_at = token_table(distinct)
    size = sizes[kinds] if len(kinds) else np.zeros(0, np.int64)
    body = chars[gather(char_at[:-1][kinds], size)] if len(kinds) else np.zeros(0, np.int64)
    body_at = offsets(size)[token_at]
    low = lowered(np.concatenate([points, body]))
    points_low, body = low(points), low(body)

    n, m, rows = np.diff(text_at), np.diff(body_at), len(text)
    solid = points != 32
    rank_at = np.concatenate([[0], np.cumsum(solid)])
    row = row_of(text_at)
    rank = rank_at[:-1] - rank_at[text_at[:-1]][row]             # characters other than blanks before, in the row
    paired = solid & (rank < m[row])
    mate = np.where(paired, body_at[:-1][row] + rank, 0)
    known = paired & (body[mate] >= 0) if len(body) else paired
    part = known & (points_low != body[mate]) if len(body) else known
    odd = np.unique(row[part])

    # last known character of each token text, and the place it stands for
    last = np.zeros(rows, np.int64)
    place = np.flatnonzero(body >= 0)
    owner = row_of(body_at)[place]
    np.maximum.at(last, owner, place - body_at[owner] + 1)
    solid_place = np.flatnonzero(solid)
    first_solid = rank_at[text_at[:-1]]
    have = rank_at[text_at[1:]] - first_solid
    end = np.zeros(rows, np.int64)
    full = (last > 0) & (last <= have)
    end[full] = solid_place[(first_solid + last - 1)[full]] - text_at[:-1][full] + 1
    end = np.where((last > 0) & ~full, n, np.minimum(n, end + m - last))

    stands = np.where(known, mate - body_at[:-1][row], -1)       # place in the row's token text
    for r in odd.tolist():
        got = meet(points_low[text_at[r]:text_at[r + 1]], body[body_at[r]:body_at[r + 1]])
        end[r] = len(got)
        stands[text_at[r]:text_at[r] + len(got)] = got
    at = gather(text_at[:-1], end)
    stands, row = stands[at], row[at]
    out = np.full(len(at), outside, np.int64)
    inside = stands >= 0
    has = inside & (stands < np.diff(label_at)[row])
    out[inside] = -1
    out[has] = codes[label_at[:-1][row[has]] + stands[has]]
    return list_column(named(names, out), end, nulls)


def split_labels(nulls: np.ndarray, annotation: pa.Array) -> pa.Array:
    """The labels of a blank-separated string."""
    trimmed = pc.utf8_trim(annotation, " ")
    parts = pc.split_pattern_regex(trimmed, r"\s+") if pc.any(pc.match_substring_regex(trimmed, r"\s\s|[^\S ]")).as_py() \
        else pc.split_pattern(trimmed, " ")
    values, at = flat_list(parts)
    some = pc.fill_null(pc.not_equal(trimmed, ""), False).to_numpy(zero_copy_only=False)
    keep = np.repeat(some, np.diff(at))
    codes, names = coded(values)
    return list_column(named(names, codes[keep]), np.where(some, np.diff(at), 0), nulls)


def label_ids(nulls: np.ndarray, labels: pa.Array) -> pa.Array:
    """Label names -> ids; an unknown or missing label fails the job."""
    values, at = flat_list(labels)
    codes, distinct = encoded(values)
    ids = pc.index_in(distinct.cast(pa.string()), value_set=pa.array(ALL_LABELS))
    if ids.null_count or (codes < 0).any():
        raise ValueError(f"unknown label: {distinct.filter(ids.is_null()).to_pylist() or None}")
    return list_column(ids.take(pa.array(codes)), np.diff(at), nulls)


def shown(nulls: np.ndarray, labels: pa.Array) -> pa.Array:
    """Labels as one blank-separated string, ``∅`` for a missing one."""
    return joined(nulls, labels, "∅")


def joined(nulls: np.ndarray, labels: pa.Array, missing: str = "O") -> pa.Array:
    """Labels as one blank-separated string, ``missing`` for a missing one."""
    values, at = flat_list(labels)
    codes, names = coded(values)
    names, outside = (names, names.index(missing)) if missing in names else ([*names, missing], len(names))
    return pc.if_else(pa.array(nulls), None, pc.binary_join(list_column(pick(names, np.where(codes < 0, outside, codes)), np.diff(at), np.zeros(len(nulls), bool)), " "))


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])


def spans(nulls: np.ndarray, labels: pa.Array) -> pa.Array:
    """Mentions as (start, end, kind), 0-based, end exclusive.

    Runs are cut wherever a position does not go on with the kind before it (``I-X`` after ``B-X`` or
    ``I-X``); a span is a run that starts with ``B-X``, so a run headed by a stray ``I-X`` is none (D6).
    """
    values, at = flat_list(labels)
    codes, names = coded(values)
    kinds: dict[str, int] = {}
    kind = np.array([kinds.setdefault(n[2:], len(kinds)) if n[:2] in ("B-", "I-") else -1 for n in names] + [-1], np.int64)[codes]
    inner = np.array([n.startswith("I-") for n in names] + [False], bool)[codes]
    opens = np.array([n.startswith("B-") for n in names] + [False], bool)[codes]
    cut = np.ones(len(codes) + 1, bool)
    if len(codes) > 1:
        cut[1:-1] = ~(inner[1:] & (kind[1:] == kind[:-1]))
    cut[at] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    is_span = opens[start]
    start, end = start[is_span], end[is_span]
    row = np.searchsorted(at, start, "right") - 1
    made = pa.StructArray.from_arrays([pa.array(start - at[row], pa.int32()), pa.array(end - at[row], pa.int32()),
                                       pick(list(kinds), kind[start])], fields=list(SPAN))
    return list_column(made, np.bincount(row, minlength=len(at) - 1), nulls)
