"""Headers as bytes, and back: fixed-width text records, and the catalogue of auxiliary data."""

from __future__ import annotations

import re

from framelake.functions import dims


class FormatError(ValueError):
    """A status code, and what it means."""

    def __init__(self, status: int, what: str = ""):
        super().__init__(f"{status}: {dims.STATUS[status]}{' (' + what + ')' if what else ''}")
        self.status = status


GLOBAL = (("nr_images", 7), ("nr_compon", 5), ("nr_fd_recs", 5), ("nr_aux_data_recs", 5), ("appl_type", 25), ("bytes_rec", 7), ("endian", 1), ("nr_aux_hdr_recs", 5))
ATTRIBUTES = (("ima_freq", 12), ("lin_freq", 12), ("pix_freq", 12), ("act_lines", 6), ("act_pixel", 6), ("interlace", 2), ("h_pp_size", 5), ("v_pp_size", 5))
STRUCTURE = (("lin_image", 6), ("pix_line", 6), ("data_fmt", 4))
SAMPLING = (("tem_sbsmpl", 2), ("lin_sbsmpl", 2), ("pix_sbsmpl", 2), ("tem_phshft", 2), ("lin_phshft", 2), ("pix_phshft", 2), ("com_code", 5))
TEXT, FLOAT = {"appl_type", "data_fmt", "com_code"}, {"ima_freq", "lin_freq", "pix_freq"}
_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def _value(name: str, raw: bytes):
    text = raw.replace(b"\0", b" ").decode("latin-1")
    if name == "endian":
        return raw
    if name in TEXT:
        if not all(32 <= ord(c) < 127 for c in text):
            raise FormatError(103, name)
        return text
    if name in FLOAT:
        if re.search(r"[^0-9 +\-eE.]", text):
            raise FormatError(103, name)
        m = _FLOAT.match(text.strip())
        return float(m[0]) if m else 0.0
    if not re.fullmatch(r" *[+-]?[0-9]* *", text) or text.strip() in "+-" and text.strip():
        raise FormatError(103, name)
    return int(text) if text.strip() else 0


def _parse(record: bytes, fields) -> dict:
    need, at, out = sum(n for _, n in fields), 0, {}
    if len(record) < need:
        raise FormatError(103, "short record")
    for name, n in fields:
        out[name] = _value(name, record[at : at + n])
        at += n
    return out


def _render(values: dict, fields, size: int) -> bytes:
    out = b""
    for name, n in fields:
        v = values[name]
        text = v if isinstance(v, bytes) else v.ljust(n)[:n].encode("latin-1") if name in TEXT else (f"{v:12f}" if name in FLOAT else f"{v:{n}d}").encode()
        if len(text) > n:
            raise FormatError(500, f"{name} = {v} does not fit in {n} characters")
        out += text
    return out.ljust(size)


def parse_aux(block: bytes) -> list[dict]:
    """Entries of 8 characters for their length (48 and the description), 16 name, 8 size, 16 unused, and the description; a shorter length ends."""
    out, at = [], 0
    number = lambda b: int(t) if (t := b.replace(b"\0", b" ").strip()).isdigit() else 0
    while at + 8 <= len(block) and (n := number(block[at : at + 8])) >= 48 and at + n <= len(block):
        name = block[at + 8 : at + 24].replace(b"\0", b" ").decode("latin-1").rstrip()
        out.append({"name": name, "max_size": number(block[at + 24 : at + 32]), "description": bytes(block[at + 48 : at + n])})
        at += n
    return out


def render_aux(aux: list[dict]) -> bytes:
    out = b"".join(f"{48 + len(a['description'] or b''):8d}".encode() + a["name"][:16].ljust(16).encode("latin-1") + f"{a['max_size']:8d}".encode() + b" " * 16 + bytes(a["description"] or b"") for a in aux) + b"       8"
    if len(out) > dims.AUX_BYTES:
        raise FormatError(229)
    return out


def color_of(h: dict) -> int:
    """C3 for one header: the last colour format whose components all match by name, subsampling and width; UNKNOWN_COLOR if none does."""
    found = dims.UNKNOWN_COLOR
    for color in dims.MATCHED:
        parts = dims.COLORS[color][1]
        fits = [c["com_code"].ljust(5) == name.ljust(5) and c["pix_sbsmpl"] == p and c["lin_sbsmpl"] == n and c["pix_line"] * p == h["act_pixel"] * many for c, (name, p, n, many) in zip(h["comp"], parts, strict=False)]
        if len(fits) == len(parts) and all(fits):
            found = color
    return found


def aux_slots(aux: list[dict]) -> list[tuple[int, int]]:
    """For each entry the position of its payload in the image's auxiliary data (-1 without one), and the size."""
    out, at = [], 0
    for a in aux:
        out.append((at if a["max_size"] > 0 else -1, a["max_size"]))
        at += a["max_size"] + 8 if a["max_size"] > 0 else 0
    return out


def parse_header(read, path: str | None = None) -> dict:
    """The header as a dict with the fields of `sequences`; read(n) gives the next n bytes."""

    def record(n: int) -> bytes:
        raw = read(n)
        if len(raw) < n:
            raise FormatError(103, "short file")
        return raw

    first = record(60)
    h = _parse(first, GLOBAL)
    size = h["bytes_rec"]
    if size < 64 or not 0 <= h["nr_aux_hdr_recs"] <= h["nr_fd_recs"]:
        raise FormatError(103, "record length or counts")
    record(size - 60)
    h |= _parse(record(size), ATTRIBUTES)
    text = record((h["nr_fd_recs"] - h["nr_aux_hdr_recs"]) * size)[: dims.DESCRIPTION_BYTES - 1]
    h["description"] = text.split(b"\0")[0].decode("latin-1")
    block = record(h["nr_aux_hdr_recs"] * size)
    if len(block) > dims.AUX_BYTES:
        raise FormatError(229)
    h["aux"] = parse_aux(block)
    if not 0 <= h["nr_compon"] <= dims.MAX_COMPONENTS:
        raise FormatError(200)
    h["comp"] = [_parse(record(size), STRUCTURE) | _parse(record(size), SAMPLING) for _ in range(h["nr_compon"])]
    h["little_endian"] = h.pop("endian") in (b"\0", b" ", b"U", b"Q")
    return h | {"path": path, "status": 0}


def render_header(h: dict) -> bytes:
    """The header's bytes; record counts are raised to what description and catalogue need."""
    h = dict(h)
    size = h["bytes_rec"]
    if size < 64:
        raise FormatError(203)
    text = (h["description"] or "").encode("latin-1", "replace")
    if len(text) >= dims.DESCRIPTION_BYTES:
        raise FormatError(225)
    plain = max(-(-dims.DESCRIPTION_BYTES // size), h["nr_fd_recs"] - h["nr_aux_hdr_recs"])
    h["nr_aux_hdr_recs"] = max(-(-dims.AUX_BYTES // size), h["nr_aux_hdr_recs"])
    h["nr_fd_recs"] = plain + h["nr_aux_hdr_recs"]
    h["nr_compon"] = len(h["comp"])
    h["endian"] = b"U" if h["little_endian"] else b"A"
    out = _render(h, GLOBAL, size) + _render(h, ATTRIBUTES, size) + text.ljust(plain * size, b"\0") + render_aux(h["aux"] or []).ljust(h["nr_aux_hdr_recs"] * size, b"\0")
    for c in h["comp"]:
        out += _render(c, STRUCTURE, size) + _render(c, SAMPLING, size)
    return out


def normalised(h: dict) -> dict:
    """The header as it is in the file that render_header() makes."""
    import io

    return parse_header(io.BytesIO(render_header(h)).read, h.get("path"))
