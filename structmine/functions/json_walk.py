"""Arrow-batch helpers that read JSON text inside tasks.

Recursion over a document is the one step Catalyst has no operator for.  Everything here
works on one Arrow batch at a time and hands back ordinary rows; grouping, joining and
shuffling stay with Spark.
"""

from __future__ import annotations

import gc
import json
import math
import sys
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle

# Workers need no installed copy of the package: the functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ARRAY_ITEM = "<ARRAY_ITEM>"

# The seven JSON type names, by bit.
TYPE_BITS = {str: 1, int: 2, float: 4, bool: 8, list: 16, dict: 32, type(None): 64}
TYPE_NAMES = {1: "string", 2: "integer", 4: "number", 8: "boolean", 16: "array", 32: "object", 64: "null"}
CONTAINER_BITS = 16 | 32

FLUSH_NODES = 200_000


def parse(line, scan=None):
    """Parsed value and True, or None and False for a line that is no JSON.

    The one rule for what is JSON: every read and every reject goes through here.  ``NaN`` and
    ``Infinity`` are numbers; a line nested deeper than the parser follows (some thousand levels)
    is rejected.  ``scan`` is ``JSONDecoder().scan_once``, what ``json.loads`` calls after a look at types and blanks;
    a line it doesn't read to the end has blanks around it or is no JSON.
    """
    if scan is not None:
        try:
            value, end = scan(line, 0)
            if end == len(line):
                return value, True
        except (StopIteration, ValueError, TypeError, RecursionError):
            pass
    try:
        return json.loads(line), True
    except (ValueError, TypeError, RecursionError):
        return None, False


def kind_of(line):
    """JSON type name of a line, None for a line that is no JSON."""
    value, ok = parse(line)
    return TYPE_NAMES[TYPE_BITS[type(value)]] if ok else None


def mark_kinds(column):
    """mapInArrow function: the batches with a last column ``json_kind`` for the text ``column``."""

    def run(batches):
        for batch in batches:
            kinds = pa.array([kind_of(x) for x in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, kinds], [*batch.schema.names, "json_kind"])

    return run


def _whole(text):
    """Text with every lone surrogate replaced by U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _texts(values, kind):
    """An Arrow column of text or lists of text, whatever characters JSON escapes put there."""
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        clean = lambda v: v if v is None else [_whole(x) for x in v] if type(v) is list else _whole(v)
        return pa.array([clean(v) for v in values], kind)


def dump(value):
    """JSON text of a value: escapes only where a lone surrogate needs one; infinite numbers become the
    largest of a double, ``NaN`` null."""
    try:
        text = json.dumps(value, ensure_ascii=False, allow_nan=False)
    except ValueError:
        text = json.dumps(_finite(value), ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "surrogatepass")
        text = "".join(c if not 0xD800 <= ord(c) < 0xE000 else f"\\u{ord(c):04x}" for c in text)
    return text


def _finite(value):
    if type(value) is dict:
        return {k: _finite(v) for k, v in value.items()}
    if type(value) is list:
        return [_finite(v) for v in value]
    if type(value) is float and not math.isfinite(value):
        return None if math.isnan(value) else math.copysign(sys.float_info.max, value)
    return value


def documents_of(line, keys):
    """Objects a line contributes: itself, or the object items of an array.

    ``keys`` are the declared root properties still to be tested here; None or an empty
    list accepts every object.
    """
    value, ok = parse(line)
    return matching_objects(value, keys) if ok else ()


def matching_objects(value, keys):
    """``documents_of`` a parsed line."""
    if type(value) is dict and not keys:
        return (value,)
    items = value if type(value) is list else (value,)
    return [x for x in items if type(x) is dict and (not keys or any(k in x for k in keys))]


def read_keys(texts):
    """Lists of declared keys from their JSON text; text, since Spark writes list columns to Arrow much slower."""
    known = {}
    for text in texts:
        if text is None:
            yield None
            continue
        found = known.get(text)
        if found is None:
            found = known[text] = json.loads(text)
        yield found


class PathCounts:
    """Counts per (dataset, path, key), kept as a tree so that no path is built per value."""

    SCHEMA = "dataset string, path array<string>, key string, n long, type_mask int, objects long"
    ARROW = pa.schema(
        [
            ("dataset", pa.string()),
            ("path", pa.list_(pa.string())),
            ("key", pa.string()),
            ("n", pa.int64()),
            ("type_mask", pa.int32()),
            ("objects", pa.int64()),
        ]
    )

    def __init__(self):
        self.roots, self.nodes = {}, 0

    def entry(self, members, key):
        """[count, type mask, members below, objects] of a key, made when first met."""
        found = members.get(key)
        if found is None:
            found = members[key] = [0, 0, {}, 0]
            self.nodes += 1
        return found

    def add(self, dataset, document):
        bits, made = TYPE_BITS, 0
        root = self.entry(self.roots, dataset)
        root[0] += 1
        root[1] |= bits[type(document)]
        root[3] += type(document) is dict
        stack = [(root[2], document)]
        while stack:
            members, value = stack.pop()
            if type(value) is dict:
                for key, child in value.items():
                    entry = members.get(key)
                    if entry is None:
                        entry = members[key] = [0, 0, {}, 0]
                        made += 1
                    kind = type(child)
                    entry[0] += 1
                    entry[1] |= bits[kind]
                    if kind is dict:
                        entry[3] += 1
                        stack.append((entry[2], child))
                    elif kind is list:
                        stack.append((entry[2], child))
            elif value:
                entry = self.entry(members, ARRAY_ITEM)
                entry[0] += len(value)
                below = entry[2]
                for child in value:
                    kind = type(child)
                    entry[1] |= bits[kind]
                    if kind is dict:
                        entry[3] += 1
                        stack.append((below, child))
                    elif kind is list:
                        stack.append((below, child))
        self.nodes += made

    def drain(self, root):
        """All counts so far as one batch; the documents themselves are member ``root`` of []."""
        columns = [[] for _ in self.ARROW]
        stack = [(dataset, [], {root: entry}) for dataset, entry in self.roots.items()]
        while stack:
            dataset, path, members = stack.pop()
            for key, (n, mask, below, objects) in members.items():
                for column, cell in zip(columns, (dataset, path, key, n, mask, objects)):
                    column.append(cell)
                if below:
                    stack.append((dataset, path + [key], below))
        self.roots, self.nodes = {}, 0
        return pa.RecordBatch.from_arrays(
            [_texts(c, f.type) for c, f in zip(columns, self.ARROW)], schema=self.ARROW
        )


class Containers:
    """Paths of objects and arrays per dataset, as a tree of their keys; scalars leave no trace."""

    SCHEMA = "dataset string, path array<string>"
    ARROW = pa.schema([("dataset", pa.string()), ("path", pa.list_(pa.string()))])

    def __init__(self):
        self.roots, self.nodes = {}, 0

    def add(self, dataset, document):
        made, root = 0, self.roots.get(dataset)
        if root is None:
            root = self.roots[dataset] = {}
        stack = [(root, document)]
        while stack:
            members, value = stack.pop()
            if type(value) is dict:
                for key, child in value.items():
                    kind = type(child)
                    if kind is dict or kind is list:
                        below = members.get(key)
                        if below is None:
                            below = members[key] = {}
                            made += 1
                        if child:
                            stack.append((below, child))
            else:
                below = None
                for child in value:
                    kind = type(child)
                    if kind is dict or kind is list:
                        if below is None:
                            below = members.get(ARRAY_ITEM)
                            if below is None:
                                below = members[ARRAY_ITEM] = {}
                                made += 1
                        if child:
                            stack.append((below, child))
        self.nodes += made

    def drain(self):
        """All paths so far as one batch."""
        datasets, paths = [], []
        stack = [(dataset, [], members) for dataset, members in self.roots.items()]
        while stack:
            dataset, path, members = stack.pop()
            for key, below in members.items():
                down = path + [key]
                datasets.append(dataset)
                paths.append(down)
                if below:
                    stack.append((dataset, down, below))
        self.roots, self.nodes = {}, 0
        return pa.RecordBatch.from_arrays(
            [_texts(c, f.type) for c, f in zip((datasets, paths), self.ARROW)], schema=self.ARROW
        )


def find_containers(batches):
    """mapInArrow function: (dataset, line) to the container paths each task meets in a dataset."""
    found = Containers()
    for batch in batches:
        with _no_collection():
            for dataset, line in zip(*(c.to_pylist() for c in batch.columns)):
                value, ok = parse(line)
                if ok and type(value) in (dict, list):
                    found.add(dataset, value)
            full = found.drain() if found.nodes > FLUSH_NODES else None
        if full is not None:
            yield full
    with _no_collection():
        rest = found.drain()
    yield rest


def count_paths(root, unnest):
    """mapInArrow function: (dataset, line, keys as JSON text) to partial counts per member path."""

    def add_all(counts, batch, scan):
        datasets, lines, keys = (c.to_pylist() for c in batch.columns)
        for dataset, line, wanted in zip(datasets, lines, read_keys(keys)):
            value, ok = parse(line, scan)
            if not ok:
                continue
            if unnest:
                for document in matching_objects(value, wanted):
                    counts.add(dataset, document)
            elif type(value) in (dict, list):
                counts.add(dataset, value)

    def run(batches):
        counts, scan = PathCounts(), json.JSONDecoder().scan_once
        for batch in batches:
            with _no_collection():
                add_all(counts, batch, scan)
                full = counts.drain(root) if counts.nodes > FLUSH_NODES else None
            if full is not None:
                yield full
        with _no_collection():
            rest = counts.drain(root)
        yield rest

    return run


@contextmanager
def _no_collection():
    """Parsed values and counts hold no cycles; looking for some while they grow takes a third of the time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def unnest_documents(batches):
    """mapInArrow function: (dataset, line, keys as JSON text) to (dataset, doc), one object per row."""
    for batch in batches:
        datasets, lines, keys = (c.to_pylist() for c in batch.columns)
        out = [
            (dataset, dump(doc))
            for dataset, line, wanted in zip(datasets, lines, read_keys(keys))
            for doc in documents_of(line, wanted)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], names=["dataset", "doc"]
        )


VALUE_SCHEMA = (
    "{carry}, path array<string>, in_list array<boolean>, type string, value string, n_children int"
)


def explode_values(n_carry, collapse_items):
    """mapInArrow function: (carried columns.., text) to one row per value inside the text.

    ``path`` leads from the root to the value.  List positions appear as ``<ARRAY_ITEM>``
    or, with ``collapse_items`` off, as their decimal index; ``in_list`` marks them.
    ``value`` is the text of a scalar, None for a container.
    """
    rest = [
        pa.field("path", pa.list_(pa.string())),
        pa.field("in_list", pa.list_(pa.bool_())),
        pa.field("type", pa.string()),
        pa.field("value", pa.string()),
        pa.field("n_children", pa.int32()),
    ]

    def rows_of(value):
        stack = [([], [], value)]
        while stack:
            path, flags, v = stack.pop()
            kind = type(v)
            size, text = None, None
            if kind is dict:
                size = len(v)
                stack.extend((path + [k], flags + [False], x) for k, x in v.items())
            elif kind is list:
                size = len(v)
                stack.extend(
                    (path + [ARRAY_ITEM if collapse_items else str(i)], flags + [True], x)
                    for i, x in enumerate(v)
                )
            else:
                text = v if kind is str else json.dumps(v)
            yield path, flags, TYPE_NAMES[TYPE_BITS[kind]], text, size

    def run(batches):
        for batch in batches:
            fields = list(batch.schema)[:n_carry] + rest
            schema = pa.schema(fields)
            carried, rows = [], []

            def flush():
                arrays = [pa.array([c[i] for c in carried], fields[i].type) for i in range(n_carry)]
                arrays += [_texts([r[i] for r in rows], f.type) for i, f in enumerate(rest)]
                out = pa.RecordBatch.from_arrays(arrays, schema=schema)
                carried.clear()
                rows.clear()
                return out

            for *carry, text in zip(*(c.to_pylist() for c in batch.columns)):
                value, ok = parse(text)
                if not ok:
                    continue
                for row in rows_of(value):
                    carried.append(carry)
                    rows.append(row)
                    if len(rows) >= FLUSH_NODES:
                        yield flush()
            yield flush()

    return run
