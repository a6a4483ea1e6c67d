"""Document structure of a PDF file as rows: info, annotations, outline, labels, fields, attachments."""

from __future__ import annotations

import json

from pagemill.sources.objects import DEPTH, Document, Name, Ref, Stream, text

INFO = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "Trapped")


def page_numbers(doc: Document) -> dict[int, int]:
    """Object numbers of pages, and their places."""
    out: dict[int, int] = {}
    n = 0
    seen: set[int] = set()

    def walk(ref, depth: int) -> None:
        nonlocal n
        node = doc.resolve(ref)
        kids = doc.resolve(node.get("Kids")) if isinstance(node, dict) else None
        if isinstance(kids, list) and depth <= DEPTH and id(node) not in seen:
            seen.add(id(node))
            for k in kids:
                walk(k, depth + 1)
        else:
            n += 1
            if isinstance(ref, Ref):
                out.setdefault(ref.num, n)

    root = doc.get(doc.trailer, "Root")
    if isinstance(root, dict) and "Pages" in root:
        walk(root["Pages"], 0)
    return out


def tree(doc: Document, node, key: str = "Names", depth: int = 0, seen: set[int] | None = None):
    """(key, value) of a name tree or a number tree, in order."""
    node = doc.resolve(node)
    seen = set() if seen is None else seen
    if not isinstance(node, dict) or depth > DEPTH or id(node) in seen:
        return
    seen.add(id(node))
    leaf = doc.resolve(node.get(key)) or []
    for k, v in zip(leaf[::2], leaf[1::2], strict=False):
        yield doc.resolve(k), v
    for kid in doc.resolve(node.get("Kids")) or []:
        yield from tree(doc, kid, key, depth + 1, seen)


def destination(doc: Document, d, names: dict, pages: dict[int, int]) -> int | None:
    """The page that a destination leads to: by name, or by its first element."""
    d = doc.resolve(d)
    if isinstance(d, (str, bytes)):
        d = doc.resolve(names.get(text(d) if isinstance(d, bytes) else str(d)))
    if isinstance(d, dict):
        d = doc.resolve(d.get("D"))
    if isinstance(d, list) and d:
        if isinstance(d[0], Ref):
            return pages.get(d[0].num)
        if isinstance(d[0], int):
            return d[0] + 1
    return None


def named_destinations(doc: Document) -> dict:
    out: dict = {}
    old = doc.get(doc.trailer, "Root", "Dests")
    if isinstance(old, dict):
        out.update(old)
    for k, v in tree(doc, doc.get(doc.trailer, "Root", "Names", "Dests")):
        out.setdefault(text(k), v)
    return out


def info(doc: Document) -> dict[str, str]:
    d = doc.get(doc.trailer, "Info")
    d = d if isinstance(d, dict) else {}
    return {k: text(doc.resolve(d.get(k))) for k in (*INFO, "CreationDate", "ModDate") if d.get(k) is not None}


def annotations(doc: Document, page: dict, names: dict, pages: dict[int, int]):
    """(type, uri, to_page, contents, rect) of a page's annotations in order."""
    for ref in doc.resolve(page.get("Annots")) or []:
        a = doc.resolve(ref)
        if not isinstance(a, dict):
            continue
        kind = str(doc.resolve(a.get("Subtype")) or "")
        kind = kind if kind in ("Link", "Text") else "Other"
        action = doc.resolve(a.get("A"))
        action = action if isinstance(action, dict) else {}
        verb = doc.resolve(action.get("S"))
        uri = text(doc.resolve(action.get("URI"))) if verb == "URI" else None
        dest = action.get("D") if verb == "GoTo" else a.get("Dest")
        rect = [float(x) for x in (doc.resolve(v) for v in doc.resolve(a.get("Rect")) or []) if isinstance(x, (int, float))]
        yield kind, uri, destination(doc, dest, names, pages) if dest is not None else None, text(doc.resolve(a.get("Contents"))), rect


def outline(doc: Document, names: dict, pages: dict[int, int]):
    """(node_id, parent_id, depth, ordinal, title, page) of the outline, parents first."""
    root = doc.get(doc.trailer, "Root", "Outlines")
    todo = [(root.get("First"), None, 0)] if isinstance(root, dict) else []
    n, seen = 0, set()
    while todo:
        ref, parent, depth = todo.pop(0)
        ordinal = 0
        while ref is not None and ordinal < DEPTH:
            node = doc.resolve(ref)
            if not isinstance(node, dict) or id(node) in seen:
                break
            seen.add(id(node))
            action = doc.resolve(node.get("A"))
            dest = node.get("Dest") or (action.get("D") if isinstance(action, dict) else None)
            yield n, parent, depth, ordinal, text(doc.resolve(node.get("Title"))), destination(doc, dest, names, pages) if dest is not None else None
            if depth < DEPTH and node.get("First") is not None:
                todo.append((node["First"], n, depth + 1))
            n, ordinal, ref = n + 1, ordinal + 1, node.get("Next")


def label_ranges(doc: Document):
    """(start, ordinal, prefix, style, st) of the page labels' ranges."""
    for i, (start, spec) in enumerate(tree(doc, doc.get(doc.trailer, "Root", "PageLabels"), "Nums")):
        spec = doc.resolve(spec)
        if isinstance(start, int) and isinstance(spec, dict):
            st = doc.resolve(spec.get("St"))
            yield start, i, text(doc.resolve(spec.get("P"))), str(doc.resolve(spec.get("S")) or ""), st if isinstance(st, int) else 1


def fields(doc: Document, pages: dict[int, int]):
    """(name, ft, flags, values, page, rect) of the terminal form fields, depth first; type, flags and value are inherited."""
    form = doc.get(doc.trailer, "Root", "AcroForm", "Fields")
    holders = {}
    for num, n in pages.items():
        for a in doc.get(Ref(num, 0), "Annots") or []:
            if isinstance(a, Ref):
                holders.setdefault(a.num, n)
    seen: set[int] = set()

    def walk(ref, name: str, given: dict, depth: int):
        node = doc.resolve(ref)
        if not isinstance(node, dict) or depth > DEPTH or id(node) in seen:
            return
        seen.add(id(node))
        part = text(doc.resolve(node.get("T")))
        name = f"{name}.{part}" if name and part else name or part
        given = {**given, **{k: doc.resolve(node[k]) for k in ("FT", "Ff", "V") if k in node}}
        kids = doc.resolve(node.get("Kids")) or []
        below = [k for k in kids if isinstance(k2 := doc.resolve(k), dict) and "T" in k2]
        if below:
            for k in below:
                yield from walk(k, name, given, depth + 1)
            return
        widget_ref = kids[0] if kids else ref
        widget = doc.resolve(widget_ref)
        widget = widget if isinstance(widget, dict) else {}
        p = widget.get("P")
        page = pages.get(p.num) if isinstance(p, Ref) else None
        if page is None and isinstance(widget_ref, Ref):
            page = holders.get(widget_ref.num)
        v = given.get("V")
        v = [doc.resolve(x) for x in v] if isinstance(v, list) else [] if v is None else [v]
        values = [text(doc.bytes(x)) if isinstance(x, Stream) else text(x) if isinstance(x, bytes) else str(x) for x in v]
        rect = [float(x) for x in (doc.resolve(q) for q in doc.resolve(widget.get("Rect")) or []) if isinstance(x, (int, float))]
        flags = given.get("Ff")
        yield name, str(given.get("FT") or ""), flags if isinstance(flags, int) else 0, values, page, rect

    for ref in form if isinstance(form, list) else []:
        yield from walk(ref, "", {}, 0)


def attachments(doc: Document):
    """(key, uf, f, mime, data) of the embedded files; those without a file are passed over."""
    for key, spec in tree(doc, doc.get(doc.trailer, "Root", "Names", "EmbeddedFiles")):
        spec = doc.resolve(spec)
        ef = doc.get(spec, "EF")
        if not isinstance(ef, dict):
            continue
        stream = doc.resolve(ef.get("UF") or ef.get("F"))
        if isinstance(stream, Stream):
            yield text(key), text(doc.resolve(spec.get("UF"))), text(doc.resolve(spec.get("F"))), str(doc.resolve(stream.dict.get("Subtype")) or ""), doc.bytes(stream)


def xmp(doc: Document) -> bytes | None:
    m = doc.get(doc.trailer, "Root", "Metadata")
    return doc.bytes(m) if isinstance(m, Stream) else None


def _plain(value):
    """An object as JSON: names begin with a slash, references are arrays of R and two numbers."""
    if isinstance(value, Stream):
        return _plain(value.dict)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, Ref):
        return ["R", value.num, value.gen]
    if isinstance(value, bytes):
        return text(value)
    return f"/{value}" if isinstance(value, Name) else value


def objects(doc: Document):
    """("object", number, generation, kind, JSON, stream length) of every object in use."""
    for num, entry in sorted(doc.xref.items()):
        if entry[0] == "free":
            continue
        gen = entry[2] if entry[0] == "at" and isinstance(entry[2], int) else 0
        v = doc.resolve(Ref(num, gen))
        kind = "stream" if isinstance(v, Stream) else {dict: "dictionary", list: "array", bytes: "string", Name: "name", bool: "boolean", type(None): "null"}.get(type(v), "number")
        yield "object", num, gen, kind, json.dumps(_plain(v), ensure_ascii=False, sort_keys=True), len(v.raw) if isinstance(v, Stream) else None
