"""A document: objects behind the cross-reference, pages, fonts, text and spans."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import fonts as font_files
from .base import MAX_BYTES, MAX_CHAIN, MAX_PAGES, Name, PdfError, Ref, Stream, as_dict
from .cmap import CMap
from .content import operations
from .crypto import Handler, handler
from .encodings import encoding_name
from .filters import decode, filter_spec, flate
from .geometry import Tracker
from .lexer import Lexer
from .parser import indirect_at, parse_object
from .textfold import THRESHOLD, extract
from .xref import Xref, parse, parse_or_repair

_VERSION = re.compile(rb"%PDF-([^\r\n \t]*)")


@dataclass
class FontInfo:
    encoding: str | None = None
    cmap: CMap | None = None
    embedded: dict | None = None
    widths: dict[int, float] = field(default_factory=dict)
    missing: float | None = None
    bold: bool = False
    italic: bool = False


class Document:
    def __init__(self, data: bytes, xref: Xref):
        self.data, self.xref = data, xref
        self.security: Handler | None = None
        self._containers: dict[int, list[tuple[int, object]]] = {}
        self._cache: dict[int, object] = {}

    @staticmethod
    def load(data: bytes, password: bytes = b"", strict: bool = False, merge: str = "newest") -> Document:
        if strict:
            xref = parse(data, merge)
            if not xref.entries:
                raise PdfError("SyntaxError", "no entries")
        else:
            xref = parse_or_repair(data, merge)
        doc = Document(data, xref)
        enc = xref.trailer.get("Encrypt")
        if enc is not None:
            if isinstance(enc, Ref):
                entry = xref.entries.get(enc.id)
                enc = indirect_at(data, entry[1])[2] if entry and entry[0] == "n" and entry[1] < len(data) else None
            if not isinstance(enc, dict):
                raise PdfError("SyntaxError", "bad /Encrypt")
            ids = doc.resolve(xref.trailer.get("ID"))
            id0 = ids[0] if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b""
            doc.security = handler(enc, id0, password)
            doc._cache.clear()
        return doc

    @property
    def encrypted(self) -> bool:
        return self.security is not None

    def object_count(self) -> int:
        return len(self.xref.entries)

    def object(self, n: int):
        """Object n, None if there is none."""
        if n in self._cache:
            return self._cache[n]
        entry = self.xref.entries.get(n)
        value = None
        if entry and entry[0] == "n":
            if entry[1] >= len(self.data):
                raise PdfError("TruncatedFile", f"expected offset {entry[1]}, file length is {len(self.data)}", entry[1])
            value = indirect_at(self.data, entry[1])[2]
            own = self.xref.trailer.get("Encrypt")
            if self.security and not (isinstance(own, Ref) and own.id == n):
                value = self.security.object(value, n, entry[2])
        elif entry and entry[0] == "c":
            value = self._compressed(n, entry[1], entry[2])
        self._cache[n] = value
        return value

    def _compressed(self, n: int, container: int, index: int):
        if container == n:
            raise PdfError("CyclicReference", f"object {n} gen 0")
        if container not in self._containers:
            at = self.xref.entries.get(container)
            if at and at[0] == "c":
                raise PdfError("CyclicReference" if at[1] == container else "Unsupported", "object stream inside an object stream")
            s = self.object(container)
            if not isinstance(s, Stream):
                raise PdfError("SyntaxError", "object stream expected")
            f = s.dict.get("Filter")
            body = flate(s.data) if f == "FlateDecode" or f == [Name("FlateDecode")] else s.data
            count, first = s.dict.get("N"), s.dict.get("First")
            if type(count) is not int or type(first) is not int:
                raise PdfError("SyntaxError", "bad object stream")
            lex, items = Lexer(body), []
            heads = [(lex.next(), lex.next()) for _ in range(min(max(count, 0), len(body)))]
            for i, offset in heads:
                if type(i) is not int or type(offset) is not int:
                    raise PdfError("SyntaxError", "bad object stream header")
                items.append((i, first + offset))
            self._containers[container] = [(i, Lexer(body, at)) for i, at in items]
        items = self._containers[container]
        if not 0 <= index < len(items):
            return None
        lex = items[index][1]
        return parse_object(Lexer(lex.data, lex.pos))

    def resolve(self, value, depth: int = 0):
        """value with references followed."""
        seen: set[int] = set()
        while isinstance(value, Ref):
            if value.id in seen:
                raise PdfError("CyclicReference", f"object {value.id} gen {value.gen}")
            if len(seen) > MAX_CHAIN:
                raise PdfError("RecursionLimitExceeded", f"reference chain over {MAX_CHAIN}")
            seen.add(value.id)
            value = self.object(value.id)
        return value

    def catalog_id(self) -> int:
        root = self.xref.trailer.get("Root")
        if not isinstance(root, Ref):
            raise PdfError("SyntaxError", "no /Root")
        return root.id

    def catalog(self) -> dict:
        d = as_dict(self.object(self.catalog_id()))
        if d is None:
            raise PdfError("SyntaxError", "no catalogue")
        return d

    def version(self) -> str:
        """Of the catalogue if it has one, else of the header."""
        try:
            v = self.catalog().get("Version")
        except PdfError:
            v = None
        return str(v) if isinstance(v, Name) else v.decode("latin-1") if isinstance(v, bytes) else header_version(self.data)

    def page_ids(self) -> list[int]:
        """Pages in order; none without a catalogue or a reference to the tree. A node met again is passed by."""
        top = self.xref.trailer.get("Root")
        root = (as_dict(self.object(top.id)) or {}).get("Pages") if isinstance(top, Ref) else None
        if not isinstance(root, Ref):
            return []
        out, seen, todo = [], set(), [root.id]
        while todo:
            n = todo.pop()
            if n in seen:
                continue
            seen.add(n)
            if len(seen) > MAX_PAGES:
                raise PdfError("Unsupported", "page tree too large")
            d = as_dict(self.object(n)) or {}
            kind = d.get("Type")
            if kind == "Page":
                out.append(n)
            elif kind == "Pages" and isinstance(d.get("Kids"), list):
                todo += [k.id for k in reversed(d["Kids"]) if isinstance(k, Ref)]
        return out

    def stream_bytes(self, value, depth: int = 0, seen: frozenset = frozenset()) -> bytes:
        """Decoded bytes of a stream, or of an array of them with a newline between."""
        if depth > MAX_CHAIN:
            raise PdfError("RecursionLimitExceeded", f"reference chain over {MAX_CHAIN}")
        if isinstance(value, Ref):
            if value.id in seen:
                raise PdfError("CyclicReference", f"object {value.id} gen {value.gen}")
            return self.stream_bytes(self.object(value.id), depth + 1, seen | {value.id})
        if isinstance(value, Stream):
            return decode(value.data, self._filters(value.dict))
        if isinstance(value, list):
            out = bytearray()
            for item in value:
                if out and out[-1] not in b"\n ":
                    out += b"\n"
                out += self.stream_bytes(item, depth + 1, seen)
                if len(out) > MAX_BYTES:
                    raise PdfError("Unsupported", "contents exceed 256 MB safety limit")
            return bytes(out)
        return b""

    def _filters(self, d: dict) -> list:
        spec = filter_spec({k: self.resolve(d[k]) for k in ("Filter", "DecodeParms", "DP") if k in d})
        for i, (name, parms) in enumerate(spec):
            if name == "JBIG2Decode" and isinstance(s := self.resolve(parms.get("JBIG2Globals")), Stream):
                spec[i] = (name, parms | {"globals": decode(s.data, self._filters(s.dict))})
        return spec

    def page_fonts(self, page: dict) -> dict[str, FontInfo]:
        """Fonts of a page's resources, else of its parent's."""
        res = as_dict(self.resolve(page.get("Resources")))
        if res is None:
            parent = as_dict(self.resolve(page.get("Parent"))) or {}
            res = as_dict(self.resolve(parent.get("Resources"))) or {}
        out = {}
        for name, ref in (as_dict(self.resolve(res.get("Font"))) or {}).items():
            d = as_dict(self.resolve(ref))
            if d is not None:
                out[name] = self._font(d)
        return out

    def _font(self, d: dict) -> FontInfo:
        info = FontInfo()
        enc = self.resolve(d.get("Encoding"))
        if isinstance(enc, dict):
            enc = enc.get("BaseEncoding")
        if isinstance(enc, Name):
            info.encoding = encoding_name(enc)
        kids = self.resolve(d.get("DescendantFonts"))
        kid = (as_dict(self.resolve(kids[0])) or {}) if isinstance(kids, list) and kids else {}
        uni = self.resolve(d.get("ToUnicode")) or self.resolve(kid.get("ToUnicode"))
        if isinstance(uni, Stream):
            info.cmap = CMap.parse(decode(uni.data, self._filters(uni.dict)))
        desc = as_dict(self.resolve(d.get("FontDescriptor"))) or as_dict(self.resolve(kid.get("FontDescriptor"))) or {}
        for key, read in (("FontFile2", font_files.truetype), ("FontFile3", font_files.cff)):
            s = self.resolve(desc.get(key))
            if info.cmap is None and isinstance(s, Stream):
                try:
                    info.cmap = read(decode(s.data, self._filters(s.dict))).to_cmap()
                except PdfError:
                    continue
        first, widths = self.resolve(d.get("FirstChar")), self.resolve(d.get("Widths"))
        if isinstance(widths, list):
            first = first if type(first) is int else 0
            info.widths = {first + i: float(w) for i, x in enumerate(widths) if isinstance(w := self.resolve(x), (int, float))}
        if isinstance(m := self.resolve(desc.get("MissingWidth")), (int, float)):
            info.missing = float(m)
        flags, weight = self.resolve(desc.get("Flags")), self.resolve(desc.get("FontWeight"))
        info.italic = type(flags) is int and bool(flags & 64)
        info.bold = isinstance(weight, (int, float)) and weight >= 700
        return info

    def _page(self, n: int) -> dict:
        return as_dict(self.object(n)) or {}

    def fonts_of(self, n: int) -> dict[str, FontInfo]:
        return self.page_fonts(self._page(n))

    def page_content(self, n: int) -> bytes:
        return self.stream_bytes(self._page(n).get("Contents"))

    def page_text(self, n: int, threshold: float = THRESHOLD, exact: bool = False) -> str:
        page = self._page(n)
        body = self.stream_bytes(page.get("Contents"))
        return extract(operations(body), self.page_fonts(page), threshold, exact) if body else ""

    def page_spans(self, n: int, threshold: float = THRESHOLD) -> list[tuple]:
        page = self._page(n)
        body = self.stream_bytes(page.get("Contents"))
        return Tracker(self.page_fonts(page), threshold).run(operations(body)) if body else []

    def xref_kind(self) -> str:
        """stream, table, or a table that was rebuilt."""
        if any(e[0] == "c" for e in self.xref.entries.values()):
            return "stream"
        base = max(0, len(self.data) - 4096)
        at = self.data.rfind(b"startxref", base)
        if at >= 0:
            try:
                n = Lexer(self.data, at + 9).next()
                if type(n) is int and 0 <= n < len(self.data):
                    t = Lexer(self.data, n).next()
                    if t == b"xref":
                        return "table"
                    if type(t) is int and isinstance(indirect_at(self.data, n)[2], Stream):
                        return "stream"
            except PdfError:
                pass
        return "reconstructed (table)" if self.xref.recovered else "table"


def header_version(data: bytes) -> str:
    m = _VERSION.search(data[:1024])
    return m[1].decode("latin-1") if m else "Unknown"
