"""Plain text from operations."""

from __future__ import annotations

from .encodings import decode_text

BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
THRESHOLD = -100.0


def extract(operations, fonts: dict | None = None, threshold: float = THRESHOLD, exact: bool = False) -> str:
    """The text that operations show. fonts: by resource name, each with .encoding, .cmap and .embedded.

    exact: once something is shown, each line and each gap counts, empty lines and blanks beside blanks too, and blanks at the ends stay.
    """
    fonts = fonts or {}
    out: list[str] = []
    last = ""  # last character so far
    block = begun = False
    encoding, cmap, embedded = "WinAnsiEncoding", None, None
    before: tuple[float, float] | None = None

    def show(raw: bytes) -> None:
        nonlocal last, begun
        begun = True
        s = cmap.decode(raw, encoding) if cmap else "".join(embedded.get(b, chr(b)) for b in raw) if embedded else decode_text(raw, encoding)
        if last == " " and s[:1] == " " and not exact:
            s = s.lstrip(BLANKS)
        if s:
            out.append(s)
            last = s[-1]

    def space() -> None:
        nonlocal last
        if exact and begun or last and last not in " \n":
            out.append(" ")
            last = " "

    def newline() -> None:
        nonlocal last
        if exact and begun or last and last != "\n":
            out.append("\n")
            last = "\n"

    for op, args in operations:
        if op == "Tj":
            if block:
                space()
                block = False
            if args and isinstance(args[0], bytes):
                show(args[0])
        elif op in ("Td", "TD"):
            if len(args) >= 2:
                x, y = (float(a) if isinstance(a, (int, float)) and not isinstance(a, bool) else 0.0 for a in args[:2])
                if y != 0.0:
                    newline()
                elif abs(x) > 2.0:
                    space()
            block = False
        elif op == "T*":
            newline()
            block = False
        elif op == "TJ":
            if block:
                space()
                block = False
            if args and isinstance(args[0], list):
                for item in args[0]:
                    if isinstance(item, bytes):
                        show(item)
                    elif isinstance(item, (int, float)) and not isinstance(item, bool) and item <= threshold:
                        space()
        elif op == "'" or op == '"':
            newline()
            block = False
            if args and isinstance(args[-1], bytes):
                show(args[-1])
        elif op == "BT":
            block = block or bool(last) and last not in " \n"
        elif op == "ET":
            block = True
        elif op == "Tm":
            if len(args) >= 6:
                x, y = (float(a) if isinstance(a, (int, float)) and not isinstance(a, bool) else 0.0 for a in args[4:6])
                if before is not None:
                    if abs(y - before[1]) > 1.0:
                        newline()
                    elif abs(x - before[0]) > 2.0:
                        space()
                before = x, y
            block = False
        elif op == "Tf" and args and isinstance(args[0], str):
            info = fonts.get(str(args[0]))
            cmap, embedded = (info.cmap, info.embedded) if info else (None, None)
            if info and info.encoding:
                encoding = info.encoding
    return "".join(out) if exact else "".join(out).strip(BLANKS)
