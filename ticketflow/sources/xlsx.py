"""Workbooks as rows of texts, as a spreadsheet program shows their cells.

The first sheet in the workbook's own order is read event by event, so memory holds the
compressed file, a chunk of XML, the rows that it ends and the place of each shared string;
the strings themselves go to an unnamed temporary file once they are large.
"""

from __future__ import annotations

import functools
import io
import posixpath
import re
import tempfile
import zipfile
from array import array
from collections.abc import Iterator
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Context, Decimal, localcontext
from fractions import Fraction
from xml.parsers import expat

CHUNK, IN_MEMORY = 1 << 16, 16 << 20
#: Signs up to the space, which are trimmed from both ends of a cell.
TRIMMED = "".join(map(chr, range(33)))
#: The formats that a file does not spell out, by their number.
FORMATS = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)",
    40: "#,##0.00_);[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
PIECE = re.compile(r'"[^"]*"?|\\.|_.|\*.|\[[^\]]*\]|AM/PM|A/P|General|E[+-]|(?:\.0+(?=[^0#?]|$))|y+|m+|d+|h+|s+|[0#?]|[.,%/@]|.', re.I | re.S)
CONDITION = re.compile(r"\[(<=|>=|<>|<|>|=)(-?[\d.]+)\]")
ELAPSED = re.compile(r"\[(h+|m+|s+)\]", re.I)
ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


# --- numbers as shown --------------------------------------------------------------------


def general(x: float) -> str:
    """Whole numbers as they are, others by ten digits, very large and very small ones with an exponent."""
    size = abs(x)
    if size >= 1e11 or 0 < size <= 1e-10:
        digits, power = f"{Decimal(repr(x)).normalize(Context(6, ROUND_HALF_UP)):E}".split("E")
        return f"{digits}E{int(power):+d}"
    if x == int(x) or size >= 1e10:
        return f"{Decimal(repr(x)).quantize(Decimal(1), ROUND_HALF_UP):f}"
    return f"{Context(10, ROUND_HALF_UP).create_decimal(repr(x)).quantize(Decimal('1e-10'), ROUND_HALF_UP).normalize():f}"


@functools.lru_cache(4096)
def sections(code: str) -> tuple[tuple[tuple[str, Decimal] | None, tuple[str, ...]], ...]:
    """The sections of a format, each with its condition and its pieces."""
    out, pieces, condition = [], [], None
    for piece in [*PIECE.findall(code), ";"]:
        if piece == ";":
            out.append((condition, tuple(pieces)))
            pieces, condition = [], None
        elif told := CONDITION.fullmatch(piece):
            condition = told[1], Decimal(told[2])
        else:
            pieces.append(piece)
    return tuple(out)


def _meets(condition: tuple[str, Decimal], x: Decimal) -> bool:
    sign, bound = condition
    return {"<": x < bound, ">": x > bound, "=": x == bound, "<=": x <= bound, ">=": x >= bound, "<>": x != bound}[sign]


def _chosen(code: str, x: Decimal) -> tuple[tuple[str, ...], bool]:
    """The section for a number, and whether the section itself stands for its sign."""
    told = sections(code)
    numbers = told[:3]
    if any(c for c, _ in numbers):
        for c, pieces in numbers:
            if c is None or _meets(c, x):
                return pieces, False
        return ("General",), False
    if len(told) > 1 and x < 0:
        return told[1][1], True
    return (told[2][1] if len(told) > 2 and not x else told[0][1]), False


def _is_date(pieces: tuple[str, ...]) -> bool:
    return any(p[0] in "yYmMdDhHsS" or ELAPSED.fullmatch(p) for p in pieces)


def _literal(piece: str) -> str:
    """What a piece shows that is no place for a digit or part of a date."""
    if piece[0] == '"':
        return piece[1:].removesuffix('"')
    if piece[0] == "\\":
        return piece[1:]
    if piece[0] == "[":
        return piece[2:-1].split("-")[0] if piece.startswith("[$") else ""
    return "" if len(piece) == 2 and piece[0] in "_*" else piece


def shown(x: float, code: str, since_1904: bool = False) -> str:
    """A number in a format; one that no date can show is shown as without a format."""
    exact = Decimal(f"{x:.15g}")
    pieces, signed = _chosen(code, exact)
    if _is_date(pieces):
        return _date(x, pieces, since_1904) if 0 <= x < 2_958_466 else general(x)
    if any(p.lower() == "general" for p in pieces) or pieces == ("@",) or not code:
        body = general(abs(x))
        text = "".join(body if p.lower() == "general" or p == "@" else _literal(p) for p in pieces) or body
    elif not any(p[0] in "0#?" or re.fullmatch(r"\.0+", p) for p in pieces):
        return "".join(map(_literal, pieces))
    else:
        with localcontext(prec=400):
            text = _digits(abs(exact), pieces)
    return text if signed or exact >= 0 else "-" + text


def _digits(x: Decimal, pieces: tuple[str, ...]) -> str:
    flat = [q for p in pieces for q in (p if re.fullmatch(r"\.0+", p) else [p])]
    x = x.scaleb(2 * flat.count("%"))
    places = [i for i, p in enumerate(flat) if p in ("0", "#", "?")]
    if "/" in flat and places[0] < flat.index("/") < len(flat) - 1:
        return _fraction(x, flat, flat.index("/"))
    power = next((i for i, p in enumerate(flat) if p in ("E+", "E-", "e+", "e-")), len(flat))
    dot = flat.index(".") if "." in flat[:power] else power
    whole, part = [i for i in places if i < dot], [i for i in places if dot < i < power]
    # a comma between digits groups them, one behind the last divides by a thousand
    commas = [i for i, p in enumerate(flat) if p == ","]
    grouped = bool(whole) and any(whole[0] < i < whole[-1] for i in commas)
    last = max([i for i in places if i < power], default=-1)
    scale = sum(1 for i in commas if i > (whole[-1] if whole else -1) and (i < dot or i > last))
    x = x.scaleb(-3 * scale)
    unit, exponent = Decimal(1).scaleb(-len(part)), 0
    if power < len(flat):
        step = len(whole) if len(whole) > 1 and "#" in (flat[i] for i in whole) else 1
        for _ in range(2):  # rounding may add a digit
            exponent = x.adjusted() - ((x.adjusted() % step) if step > 1 else max(len(whole), 1) - 1) if x else 0
            y = x.scaleb(-exponent).quantize(unit, ROUND_HALF_UP)
            if not y or y.adjusted() < max(len(whole), 1):
                break
            x = y.scaleb(exponent)
    else:
        y = x.quantize(unit, ROUND_HALF_UP)
    left, _, right = f"{y:f}".partition(".")
    left = left.lstrip("0")
    out = {}
    for back, i in enumerate(reversed(whole)):
        most = len(left) if i == whole[0] else back + 1
        # the first place takes all digits that are left
        own = left[len(left) - most : len(left) - back] if len(left) > back else {"0": "0", "?": " ", "#": ""}[flat[i]]
        if grouped:
            at = len(own) + back
            own = "".join(c + ("," if (n := at - k - 1) and n % 3 == 0 and c != " " else "") for k, c in enumerate(own))
        out[i] = own
    if not whole and left:
        out[dot] = left
    kept = max([len(right.rstrip("0")), *(n + 1 for n, i in enumerate(part) if flat[i] == "0")])
    for n, i in enumerate(part):
        out[i] = right[n] if n < kept else " " if flat[i] == "?" else ""
    if dot < power:
        out[dot] = out.get(dot, "") + ("." if kept or not part else "")
    if power < len(flat):
        behind = [i for i in places if i > power]
        out[power] = "E" + ("-" if exponent < 0 else "+" if flat[power][1] == "+" else "") + str(abs(exponent)).zfill(sum(flat[i] == "0" for i in behind))
        out |= dict.fromkeys(behind, "")
    out |= {i: "" for i in commas if i not in out and (grouped and whole[0] < i < whole[-1] or i > (whole[-1] if whole else -1) and (i < dot or i > last))}
    return "".join(out[i] if i in out else _literal(p) for i, p in enumerate(flat))


def _fraction(x: Decimal, flat: list[str], slash: int) -> str:
    """A whole number, where the format has a place for it, and the nearest fraction of so many digits."""
    above = slash - next((n for n, p in enumerate(reversed(flat[:slash])) if p not in "0#?"), slash)
    under = flat[slash + 1 :]
    apart = any(p in ("0", "#", "?") for p in flat[:above])
    fixed = re.match(r"\d+", "".join(under)) if under[0].isdigit() and under[0] != "0" else None
    exact, whole = Fraction(x), 0
    if apart:
        whole, exact = int(exact), exact - int(exact)
    if fixed:
        bottom = int(fixed[0])
        top = int(exact * bottom + Fraction(1, 2))
    else:
        near = exact.limit_denominator(10 ** max(1, sum(p in ("0", "#", "?") for p in under)) - 1)
        top, bottom = near.numerator, near.denominator
    if apart and top == bottom:
        whole, top = whole + 1, 0
    if apart and not top:
        return str(whole)
    return (f"{whole} " if whole else "") + f"{top}/{bottom}"


def _date(x: float, pieces: tuple[str, ...], since_1904: bool) -> str:
    """A day count and its part of a day, rounded to milliseconds; the first two months of 1900 count from a day later."""
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31) if x < 61 else datetime(1899, 12, 30)
    ms = round(x * 86_400_000)
    at = start + timedelta(milliseconds=ms)
    kinds = [ELAPSED.fullmatch(p)[1][0].lower() if ELAPSED.fullmatch(p) else p[0].lower() if p[0] in "yYmMdDhHsS" else "" for p in pieces]
    half = any(p.upper() in ("AM/PM", "A/P") for p in pieces)
    parts = [i for i, k in enumerate(kinds) if k]
    out = []
    for i, p in enumerate(pieces):
        kind, n = kinds[i], len(p)
        if p[0] == "[" and kind:
            out.append(str(ms // {"h": 3_600_000, "m": 60_000, "s": 1000}[kind]).zfill(n - 2))
        elif kind == "m" and n < 3 and (kinds[max([j for j in parts if j < i], default=i)] == "h" or kinds[min([j for j in parts if j > i], default=i)] == "s"):
            out.append(str(at.minute).zfill(n))
        elif kind == "m":
            name = MONTHS[at.month - 1]
            out.append(str(at.month).zfill(n) if n < 3 else name[:3] if n == 3 else name[0] if n == 5 else name)
        elif kind == "y":
            out.append(f"{at.year % 100:02d}" if n < 3 else str(at.year))
        elif kind == "d":
            name = DAYS[at.weekday()]
            out.append(str(at.day).zfill(n) if n < 3 else name[:3] if n == 3 else name)
        elif kind == "h":
            out.append(str((at.hour - 1) % 12 + 1 if half else at.hour).zfill(min(n, 2)))
        elif kind == "s":
            out.append(str(at.second).zfill(min(n, 2)))
        elif p.upper() in ("AM/PM", "A/P"):
            word = "AM" if at.hour < 12 else "PM"
            out.append(word if len(p) > 3 else word[0])
        elif re.fullmatch(r"\.0+", p):
            out.append("." + f"{at.microsecond:06d}"[: n - 1])
        else:
            out.append("" if p == "@" else _literal(p))
    return "".join(out)


# --- the file ----------------------------------------------------------------------------


def unescaped(text: str) -> str:
    """_xHHHH_ stands for a sign that XML cannot hold."""
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def escaped(text: str) -> str:
    """The inverse of unescaped, as XML text."""
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)|[\x00-\x08\x0b-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def events(part, start, end, data) -> Iterator[None]:
    """Feeds a part of the file to handlers by chunks; names come without their namespace. Stops after each chunk."""
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler = lambda name, attributes: start(name.rpartition(" ")[2], {k.rpartition(" ")[2]: v for k, v in attributes.items()})
    parser.EndElementHandler = lambda name: end(name.rpartition(" ")[2])
    parser.CharacterDataHandler = data
    while chunk := part.read(CHUNK):
        parser.Parse(chunk, False)
        yield
    parser.Parse(b"", True)
    yield


def _elements(z: zipfile.ZipFile, name: str) -> list[tuple[str, dict]]:
    """All start tags of a small part, in order; none where it is missing."""
    found: list[tuple[str, dict]] = []
    if name in z.namelist():
        with z.open(name) as part:
            for _ in events(part, lambda tag, a: found.append((tag, a)), lambda _: None, lambda _: None):
                pass
    return found


def _target(z: zipfile.ZipFile, of: str, fits) -> str | None:
    """The part that a relationship of another names."""
    folder, base = posixpath.split(of)
    for tag, a in _elements(z, posixpath.join(folder, "_rels", base + ".rels")):
        if tag == "Relationship" and fits(a):
            return posixpath.normpath(posixpath.join("/" + folder, a["Target"])).lstrip("/")
    return None


class Strings:
    """The shared strings, in a file, and the place where each ends."""

    def __init__(self, z: zipfile.ZipFile, name: str | None):
        self._ends, self._held = array("Q", [0]), tempfile.SpooledTemporaryFile(IN_MEMORY)
        if name is None or name not in z.namelist():
            return
        depth, words = {"t": 0, "rPh": 0}, []

        def start(tag, _):
            if tag in depth:
                depth[tag] += 1

        def end(tag):
            if tag in depth:
                depth[tag] -= 1
            elif tag == "si":
                self._held.write(unescaped("".join(words)).encode("utf-8", "surrogatepass"))
                self._ends.append(self._held.tell())
                words.clear()

        def data(text):
            # how a word is spoken is not part of it
            if depth["t"] and not depth["rPh"]:
                words.append(text)

        with z.open(name) as part:
            for _ in events(part, start, end, data):
                pass

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self._ends) - 1:
            return ""
        self._held.seek(self._ends[i])
        return self._held.read(self._ends[i + 1] - self._ends[i]).decode("utf-8", "replace")

    def close(self) -> None:
        self._held.close()


def _styles(z: zipfile.ZipFile, name: str | None) -> list[str]:
    """The format of each cell style."""
    own, out, within = dict(FORMATS), [], False
    for tag, a in _elements(z, name or ""):
        if tag == "numFmt":
            own[int(a["numFmtId"])] = a.get("formatCode", "")
        elif tag in ("cellXfs", "cellStyleXfs", "cellStyles", "dxfs"):
            within = tag == "cellXfs"
        elif tag == "xf" and within:
            out.append(own.get(int(a.get("numFmtId", 0)), ""))
    return out


def column(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def rows(data: bytes) -> Iterator[tuple[int, list[str]]]:
    """The rows of the first sheet from 1 on, as they stand in the file: numbers that are left out do not count.

    Texts are trimmed; a cell that is not there is empty, and a row may have none. A formula is shown
    as its text, or as its last result if it only refers to another's.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = _target(z, "", lambda a: a.get("Type", "").endswith("/officeDocument")) or "xl/workbook.xml"
        parts = _elements(z, book)
        since_1904 = any(tag == "workbookPr" and a.get("date1904") in ("1", "true") for tag, a in parts)
        first = next((a.get("id") for tag, a in parts if tag == "sheet"), None)
        sheet = _target(z, book, lambda a: a.get("Id") == first)
        if sheet is None:
            sheet = min((n for n in z.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        of_type = lambda kind: _target(z, book, lambda a: a.get("Type", "").endswith(kind))
        styles = _styles(z, of_type("/styles") or "xl/styles.xml")
        strings = Strings(z, of_type("/sharedStrings") or "xl/sharedStrings.xml")
        try:
            with z.open(sheet) as part:
                yield from _rows(part, styles, strings, since_1904)
        finally:
            strings.close()


def _rows(part, styles: list[str], strings: Strings, since_1904: bool) -> Iterator[tuple[int, list[str]]]:
    done: list[list[str]] = []
    row: list[str] = []
    cell: dict = {}
    texts: dict[str, list[str]] = {"v": [], "f": [], "t": []}
    open_tags = {"v": 0, "f": 0, "t": 0, "rPh": 0}

    def start(tag, a):
        if tag == "row":
            row.clear()
        elif tag == "c":
            cell.clear()
            cell.update(a)
            for words in texts.values():
                words.clear()
        elif tag in open_tags:
            open_tags[tag] += 1

    def end(tag):
        if tag in open_tags:
            open_tags[tag] -= 1
        elif tag == "c":
            at = column(cell["r"]) if cell.get("r") else len(row)
            row.extend([""] * (at + 1 - len(row)))
            row[at] = _text(cell, *("".join(texts[k]) for k in ("v", "f", "t")), styles, strings, since_1904).strip(TRIMMED)
        elif tag == "row":
            done.append(row.copy())

    def data(text):
        for kind in texts:
            if open_tags[kind] and not open_tags["rPh"]:
                texts[kind].append(text)

    n = 0
    for _ in events(part, start, end, data):
        for cells in done:
            n += 1
            yield n, cells
        done.clear()


def _text(cell: dict, value: str, formula: str, inline: str, styles: list[str], strings: Strings, since_1904: bool) -> str:
    kind = cell.get("t", "n")
    if formula:
        return formula
    if kind == "inlineStr":
        return unescaped(inline)
    if not value:
        return ""
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "TRUE" if value.strip() in ("1", "true") else "FALSE"
    if kind != "n":
        return unescaped(value)
    style = int(cell.get("s", 0))
    return shown(float(value), styles[style] if style < len(styles) else "", since_1904)
