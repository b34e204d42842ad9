"""Columnar JSON flattening over Arrow buffers.

A batch of JSON texts is never parsed row by row. Its Arrow data buffer is scanned as
one byte vector: quotes and escapes give the in-string mask, structural bytes outside
strings give tokens, a running sum of brackets gives depth, and a search among the
openers of one depth gives every token its parent. Child rows are then emitted level by
level, taking paths and keys from the parent with vectorised ``take``. Strings that hold
JSON text themselves feed another round, with the path reached so far as their prefix.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OPEN_O, CLOSE_O, OPEN_A, CLOSE_A, COMMA, COLON, STRING, SCALAR = range(8)
_KIND = np.full(256, -1, np.int8)
for _byte, _kind in zip(b"{}[],:", range(6)):
    _KIND[_byte] = _kind
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r")] = True
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_SCALAR_RE = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity")
_BOM = b"\xef\xbb\xbf"


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary array without nulls, both starting at 0."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges [start, end) as a binary array (gather by offsets)."""
    size = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    where = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[where]))])


def _unescape(raw: pa.Array) -> pa.Array:
    """JSON string contents as text; only distinct values with a backslash are decoded."""
    coded = raw.dictionary_encode()
    said = coded.dictionary.to_pylist()
    for i, x in enumerate(said):
        text = json.loads(b'"' + x + b'"', strict=False) if b"\\" in x else x.decode("utf-8", "replace")
        said[i] = text.encode("utf-8", "replace").decode()
    return pa.array(said, pa.large_string()).take(coded.indices)


def _structure(offsets: np.ndarray, data: np.ndarray):
    """Tokens of all rows: position, end, kind, row, escape mask and the rows found bad."""
    rows = len(offsets) - 1
    bad = np.zeros(rows, bool)
    row_of = lambda p: np.searchsorted(offsets, p, "right") - 1
    slash = np.flatnonzero(data == 92)
    escaped = np.zeros(len(data) + 1, bool)
    if len(slash):
        first = np.ones(len(slash), bool)
        first[1:] = (np.diff(slash) != 1) | (row_of(slash[1:]) != row_of(slash[:-1]))
        run = np.cumsum(first) - 1
        nth = np.arange(len(slash)) - np.flatnonzero(first)[run]
        esc = slash[nth % 2 == 0] + 1
        last = esc >= offsets[row_of(esc - 1) + 1]
        bad[row_of(esc[last] - 1)] = True
        esc = esc[~last]
        escaped[esc] = True
    quote = np.flatnonzero((data == 34) & ~escaped[:-1])
    row_q = row_of(quote)
    nth_q = np.arange(len(quote)) - np.searchsorted(quote, offsets[row_q])
    per_row = np.bincount(row_q, minlength=rows)
    bad |= per_row % 2 == 1
    step = np.zeros(len(data) + 1, np.int8)
    keep = ~bad[row_q]
    opening, closing = quote[keep & (nth_q % 2 == 0)], quote[keep & (nth_q % 2 == 1)]
    step[opening] += 1
    step[closing + 1] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)  # from the opening quote to the closing one
    control = np.flatnonzero((data < 32) & inside)
    bad[row_of(control)] = True
    if len(slash):
        bad[row_of(slash[~inside[slash]])] = True
        esc = esc[inside[esc]]
        bad[row_of(esc[~_ESCAPABLE[data[esc]]])] = True
        u = esc[data[esc] == 117]
        pad = np.concatenate([data, np.zeros(4, np.uint8)])
        hexed = _HEX[pad[u + 1]] & _HEX[pad[u + 2]] & _HEX[pad[u + 3]] & _HEX[pad[u + 4]]
        bad[row_of(u[~hexed])] = True
    kind = _KIND[data]
    kind[inside] = -1
    rest = ~inside & (kind < 0) & ~_SPACE[data]
    begins = rest.copy()
    begins[1:] &= ~rest[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] |= rest[offsets[:-1][offsets[:-1] < len(data)]]
    scalar = np.flatnonzero(begins)
    edge = np.flatnonzero(rest & ~np.concatenate([rest[1:], [False]])) + 1
    ends_at = np.minimum(edge[np.searchsorted(edge, scalar, "right")] if len(scalar) else scalar, offsets[row_of(scalar) + 1])
    kind[opening] = STRING
    kind[scalar] = SCALAR
    pos = np.flatnonzero(kind >= 0)
    kind = kind[pos]
    end = pos + 1
    end[kind == STRING] = closing + 1
    end[kind == SCALAR] = ends_at
    row = row_of(pos)
    if len(scalar):
        coded = _slices(data, scalar, ends_at).dictionary_encode()
        good = np.array([bool(_SCALAR_RE.fullmatch(x)) for x in coded.dictionary.to_pylist()], bool)
        bad[row_of(scalar[~good[coded.indices.to_numpy(zero_copy_only=False)]])] = True
    empty = np.ones(rows, bool)
    empty[row] = False
    return pos, end, kind, row, bad | empty


def _parents(kind: np.ndarray, row: np.ndarray, bad: np.ndarray):
    """Depth and index of the opening token that contains each token (-1: top), bad rows marked."""
    opens = (kind == OPEN_O) | (kind == OPEN_A)
    closes = (kind == CLOSE_O) | (kind == CLOSE_A)
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    depth = np.cumsum(opens.astype(np.int32) - closes)
    start = np.flatnonzero(first)
    base = np.where(start > 0, depth[start - 1], 0)
    at = np.cumsum(first) - 1
    depth = depth - base[at] + closes - opens  # a bracket lies in what contains it; a close is put beside its contents below
    depth[closes] -= 1
    last = np.concatenate([first[1:], [True]])
    bad[row[depth < 0]] = True
    bad[row[last & ((depth + opens) != 0)]] = True
    inner = np.where(closes, depth + 1, depth)
    stride = np.int64(len(kind) + 1)
    openers = np.flatnonzero(opens)
    code = np.sort(depth[openers] * stride + openers)  # openers level by level
    parent = np.full(len(kind), -1, np.int64)
    within = np.flatnonzero(inner > 0)
    if len(code) and len(within):
        found = np.searchsorted(code, (inner[within] - 1) * stride + within) - 1
        level, got = np.divmod(code[np.maximum(found, 0)], stride)
        wrong = (found < 0) | (level != inner[within] - 1) | (row[got] != row[within])
        bad[row[within[wrong]]] = True
        parent[within] = np.where(wrong, -1, got)
    else:
        bad[row[within]] = True
    return depth, parent, opens, closes


def _grammar(kind, row, parent, opens, closes, bad) -> np.ndarray:
    """Marks rows whose neighbouring tokens break JSON's grammar; True for object keys."""
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    before = np.concatenate([[-1], kind[:-1]]).astype(np.int8)
    before[first] = -1
    inside = np.where(parent >= 0, kind[np.maximum(parent, 0)], -1)
    value = opens | (kind == STRING) | (kind == SCALAR)
    in_o, in_a, top = inside == OPEN_O, inside == OPEN_A, inside == -1
    key = in_o & (kind == STRING) & ((before == OPEN_O) | (before == COMMA))
    after_key = np.concatenate([[False], key[:-1]])
    after_value = ((before == STRING) & ~after_key) | (before == SCALAR) | (before == CLOSE_O) | (before == CLOSE_A)
    ok = np.zeros(len(kind), bool)
    ok |= top & value & (before == -1)
    ok |= in_o & (key | (value & (before == COLON)) | ((kind == COLON) & after_key) | ((kind == COMMA) & after_value) | ((kind == CLOSE_O) & (after_value | (before == OPEN_O))))
    ok |= in_a & ((value & ((before == OPEN_A) | (before == COMMA))) | ((kind == COMMA) & after_value) | ((kind == CLOSE_A) & (after_value | (before == OPEN_A))))
    bad[row[~ok]] = True
    return key


def _ordinals(kind: np.ndarray, parent: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """0-based place of each wanted token in its array: the separators before it."""
    comma = np.flatnonzero((kind == COMMA) & (parent >= 0))
    order = comma[np.argsort(parent[comma], kind="stable")]
    stride = np.int64(len(kind) + 1)
    code = parent[order] * stride + order
    lo = np.searchsorted(code, parent[wanted] * stride)
    return np.searchsorted(code, parent[wanted] * stride + wanted) - lo


def _join(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string()))


def flatten(texts: pa.Array, ids: np.ndarray, list_fields: Iterable[str], with_json: bool = False, child: tuple[str, tuple[str, ...]] | None = None) -> pa.Table:
    """One row for each object that is an element of a list, at any depth.

    ``texts`` is a binary or string array, ``ids`` its row keys. Columns: ``row`` (the key),
    ``path``, ``parent_path`` (path of the nearest emitted object above, "" for the top),
    ``json`` (the object's own text, only ``with_json``). With ``child`` (name of a list, names of fields) only the
    objects of lists of that name come out, with two columns for each field, cut from the buffer: its value as text
    (a string without its quotes, else as written; null for null and where there is none) and whether it is a string.
    Null, empty and unreadable texts give no row;
    a byte-order mark before the text is passed over; of repeated keys the last one counts.
    """
    fields = pa.array(sorted(list_fields), pa.large_string())
    ids = np.asarray(ids)
    valid = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
    texts = texts.take(pa.array(valid)).cast(pa.large_binary())
    frontier = (texts, ids[valid], pa.array([""] * len(valid), pa.large_string()), pa.array([""] * len(valid), pa.large_string()), np.zeros(len(valid), np.int8))
    out: list[pa.Table] = []
    while len(frontier[0]):
        found, frontier = _round(*frontier, fields, with_json, child)
        out.append(found)
    schema = pa.schema([("row", pa.from_numpy_dtype(ids.dtype)), ("path", pa.large_string()), ("parent_path", pa.large_string()), ("json", pa.large_string())])
    for i in range(len(child[1]) if child else 0):
        schema = schema.append(pa.field(f"v{i}", pa.large_string())).append(pa.field(f"s{i}", pa.bool_()))
    return pa.concat_tables(out) if out else schema.empty_table()


def _values(data, pos, end, closer, kind, value, place, rows) -> tuple[pa.Array, pa.Array]:
    """Text of the value tokens and whether they are strings, at their places among ``rows`` rows."""
    text = kind[value] == STRING
    start = pos[value] + text
    stop = np.where((kind[value] == OPEN_O) | (kind[value] == OPEN_A), closer[value], end[value] - text)
    raw = _slices(data, start, stop)
    where = np.full(rows, -1, np.int64)
    where[place] = np.arange(len(value))
    said = pa.concat_arrays([_unescape(raw.filter(pa.array(text))), raw.filter(pa.array(~text)).cast(pa.large_string(), safe=False)])
    nth = np.where(text, np.cumsum(text) - 1, text.sum() + np.cumsum(~text) - 1)
    none = where < 0
    taken = said.take(pa.array(np.where(none, 0, nth[where] if len(nth) else 0), mask=none))
    strings = pa.array(text[where] if len(text) else np.zeros(rows, bool), mask=none)
    null = pc.fill_null(pc.and_(pc.equal(taken, "null"), pc.invert(strings)), False)
    return pc.if_else(null, pa.scalar(None, pa.large_string()), taken), strings


#: How an object found at the top of a text counts: not as an element, as one, as the lone one of a list field.
PLAIN, ELEMENT, LONE = 0, 1, 2


def _round(texts, ids, prefix, above, role, fields, with_json, child):
    offsets, data = _buffers(texts)
    if len(data) >= 3:  # a byte-order mark is blanked in place
        starts = offsets[:-1][np.diff(offsets) >= 3]
        marked = starts[(data[starts] == _BOM[0]) & (data[starts + 1] == _BOM[1]) & (data[starts + 2] == _BOM[2])]
        if len(marked):
            data = data.copy()
            for k in range(3):
                data[marked + k] = 32
    pos, end, kind, row, bad = _structure(offsets, data)
    depth, parent, opens, closes = _parents(kind, row, bad)
    key = _grammar(kind, row, parent, opens, closes, bad)
    live = ~bad[row]
    keep = np.cumsum(live) - 1
    parent = np.where(parent >= 0, keep[np.maximum(parent, 0)], -1)[live]
    pos, end, kind, row, depth, key, opens = (x[live] for x in (pos, end, kind, row, depth, key, opens))

    # Keys: the value of a key token stands two tokens on.
    key_at = np.flatnonzero(key)
    names = _unescape(_slices(data, pos[key_at] + 1, end[key_at] - 1))
    coded = names.dictionary_encode()
    is_list = pc.is_in(coded.dictionary, fields).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()] if len(key_at) else np.zeros(0, bool)
    key_of = np.full(len(kind), -1, np.int64)
    key_of[key_at + 2] = np.arange(len(key_at))
    dead = np.zeros(len(kind), bool)
    if len(key_at):
        code = parent[key_at] * np.int64(len(coded.dictionary)) + coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        again = np.flatnonzero(code[order][1:] == code[order][:-1])
        dead[key_at[order[again]] + 2] = True

    may_hold = np.flatnonzero((kind == STRING) & ~key)
    if len(may_hold):  # strings with an object in them as text
        raw = _slices(data, pos[may_hold] + 1, end[may_hold] - 1)
        hit = pc.or_(pc.match_substring(raw, b"{"), pc.match_substring_regex(raw, r"\\u007[bB]")).to_numpy(zero_copy_only=False)
        first = data[np.minimum(pos[may_hold] + 1, max(len(data) - 1, 0))]
        hit &= np.isin(first, np.frombuffer(b'{["\\ \xef', np.uint8))
        may_hold, raw = may_hold[hit], raw.filter(pa.array(hit))
    node = np.zeros(len(kind), bool)
    node[opens] = True
    node[may_hold] = True

    slot = np.full(len(kind), -1, np.int64)  # where a token's path stands among those of its level
    paths = ups = pa.array([], pa.large_string())
    emitted: list[tuple] = []
    following: list[tuple] = []
    ordinal = np.full(len(kind), -1, np.int64)
    in_array = np.flatnonzero(node & (parent >= 0))
    in_array = in_array[kind[parent[in_array]] == OPEN_A]
    if len(in_array):
        ordinal[in_array] = _ordinals(kind, parent, in_array)
    by_depth = np.flatnonzero(node)
    by_depth = by_depth[np.argsort(depth[by_depth], kind="stable")]
    cuts = np.searchsorted(depth[by_depth], np.arange(int(depth[by_depth[-1]]) + 2)) if len(by_depth) else np.zeros(1, np.int64)
    # What each node adds to the path of its parent, and how it counts, for all levels at once.
    in_a = ordinal[by_depth] >= 0
    named = key_of[by_depth] >= 0
    name = names.take(pa.array(np.where(named, key_of[by_depth], 0), mask=~named)) if len(key_at) else pa.nulls(len(by_depth), pa.large_string())
    nth = pa.array(np.where(in_a, ordinal[by_depth], 0)).cast(pa.large_string())
    tails = pc.if_else(pa.array(in_a), _join(pa.scalar("[", pa.large_string()), nth, pa.scalar("]", pa.large_string())), _join(pa.scalar(".", pa.large_string()), pc.fill_null(name, "")))
    lone_of, element_of = np.zeros(len(by_depth), bool), in_a
    if len(key_at):
        lone_of[named] = is_list[key_of[by_depth[named]]]
    dotless = np.zeros(len(kind), bool)  # an empty path gets no dot behind it
    for level, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        here = by_depth[lo:hi]
        if level:
            live = ~(dead[here] | dead[parent[here]])
            dead[here] = ~live
        else:
            live = ~dead[here]
        all_live = live.all()
        here = here if all_live else here[live]
        if not len(here):
            break  # what lies deeper lies in nothing that counts
        kinds = kind[here]
        if level == 0:
            rows_here = pa.array(row[here])
            path, up = prefix.take(rows_here), above.take(rows_here)
            how = role[row[here]]
            lone, element = how == LONE, how == ELEMENT
            dotless[here] = pc.equal(pc.binary_length(path), 0).to_numpy(zero_copy_only=False)
        else:
            held = pa.array(slot[parent[here]])
            up, tail = ups.take(held), tails.slice(lo, hi - lo)
            lone, element = lone_of[lo:hi], element_of[lo:hi]
            if not all_live:
                tail, lone, element = tail.filter(pa.array(live)), lone[live], element[live]
            bare = dotless[parent[here]] & ~element
            if bare.any():
                tail = pc.if_else(pa.array(bare), pc.utf8_slice_codeunits(tail, 1), tail)
                dotless[here] = bare & pc.equal(pc.binary_length(tail), 0).to_numpy(zero_copy_only=False)
            path = _join(paths.take(held), tail)
        texty = kinds == STRING
        counts = (kinds == OPEN_O) & (lone | element)
        alone = (kinds == OPEN_O) & lone
        if alone.any():
            path = pc.if_else(pa.array(alone), _join(path, pa.scalar("[0]", pa.large_string())), path)
            dotless[here] &= ~alone
        if counts.any():
            mask = pa.array(counts)
            emitted.append((here[counts], path.filter(mask), up.filter(mask)))
            up = pc.if_else(mask, path, up)
        if texty.any():
            mask = pa.array(texty)
            following.append((here[texty], path.filter(mask), up.filter(mask), np.where(lone, LONE, np.where(element, ELEMENT, PLAIN))[texty].astype(np.int8)))
        slot[here] = np.arange(len(here))
        paths, ups = path, up  # parents lie one level up

    tokens = np.concatenate([x[0] for x in emitted]) if emitted else np.zeros(0, np.int64)
    closer = np.zeros(len(kind), np.int64)
    shut = np.flatnonzero((kind == CLOSE_O) & (parent >= 0))
    closer[parent[shut]] = end[shut]
    shut = np.flatnonzero((kind == CLOSE_A) & (parent >= 0))
    closer[parent[shut]] = end[shut]
    path = pa.concat_arrays([x[1] for x in emitted]) if emitted else pa.array([], pa.large_string())
    up = pa.concat_arrays([x[2] for x in emitted]) if emitted else pa.array([], pa.large_string())
    columns = {}
    if child:
        mine = pc.match_substring_regex(path, r"(?:^|\.)" + re.escape(child[0]) + r"(?:\[\d+\])+$")
        path, up, tokens = path.filter(mine), up.filter(mine), tokens[mine.to_numpy(zero_copy_only=False)]
        order = np.argsort(tokens)
        for i, name in enumerate(child[1]):
            at = coded.dictionary.index(name).as_py()
            value = key_at[coded.indices.to_numpy() == at] + 2 if len(key_at) and at >= 0 else np.zeros(0, np.int64)
            value = value[~dead[value]]
            place = np.minimum(np.searchsorted(tokens[order], parent[value]), max(len(tokens) - 1, 0))
            hit = tokens[order[place]] == parent[value] if len(tokens) else np.zeros(len(value), bool)
            value, place = value[hit], order[place[hit]] if len(tokens) else place[:0]
            columns[f"v{i}"], columns[f"s{i}"] = _values(data, pos, end, closer, kind, value, place, len(tokens))
    found = pa.table({
        "row": pa.array(ids[row[tokens]]),
        "path": path,
        "parent_path": up,
        "json": _slices(data, pos[tokens], closer[tokens]).cast(pa.large_string(), safe=False) if with_json else pa.nulls(len(tokens), pa.large_string()),
        **columns,
    })
    if not following:
        return found, (pa.array([], pa.large_binary()),) * 4 + (np.zeros(0, np.int8),)
    tokens = np.concatenate([x[0] for x in following])
    place = np.searchsorted(may_hold, tokens)
    inner = _unescape(raw.take(pa.array(place))).cast(pa.large_binary())
    return found, (inner, ids[row[tokens]], pa.concat_arrays([x[1] for x in following]), pa.concat_arrays([x[2] for x in following]), np.concatenate([x[3] for x in following]))
