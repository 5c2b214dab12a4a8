"""Constant tables: colour formats, frequencies, rasters, data formats, status codes."""

from __future__ import annotations

#: Components of a colour format: name, pixel and line subsampling, samples that share a position.
COLORS: dict[int, tuple[str, tuple[tuple[str, int, int, int], ...]]] = {
    0: ("NO_COLOR", (("Y", 1, 1, 1),)),
    1: ("422", (("Y", 1, 1, 1), ("U/V", 2, 1, 2))),
    2: ("420", (("Y", 1, 1, 1), ("U/V", 2, 2, 2))),
    3: ("444_PL", (("Y", 1, 1, 1), ("U", 1, 1, 1), ("V", 1, 1, 1))),
    4: ("422_PL", (("Y", 1, 1, 1), ("U", 2, 1, 1), ("V", 2, 1, 1))),
    5: ("420_PL", (("Y", 1, 1, 1), ("U", 2, 2, 1), ("V", 2, 2, 1))),
    6: ("RGB", (("R", 1, 1, 1), ("G", 1, 1, 1), ("B", 1, 1, 1))),
    7: ("STREAM", (("S", 1, 1, 1),)),
    8: ("XYZ", (("X", 1, 1, 1), ("Y", 1, 1, 1), ("Z", 1, 1, 1))),
}
UNKNOWN_COLOR = 9
#: Order in which formats are matched; the last that fits counts.
MATCHED = (0, 1, 2, 3, 4, 5, 6, 8, 7)
STANDARD_COMPONENTS = {c: len(parts) for c, (_, parts) in COLORS.items()}

#: Image frequencies that a header can be made with.
FREQUENCIES = {"50": 50.0, "60": 59.94, "REAL_60": 60.0, "25": 25.0, "24": 23.976, "REAL_24": 24.0, "30": 29.97, "REAL_30": 30.0}
#: All that are told apart, in the order of comparison.
CLASSES = {**FREQUENCIES, "75": 75.0, "90": 89.91, "REAL_90": 90.0, "100": 100.0, "120": 119.88, "REAL_120": 120.0}
FILM = ("24", "25", "30", "REAL_24", "REAL_30")
_FIFTY, _EXACT = ("50", "25"), ("REAL_60", "REAL_30", "REAL_24")

_LINES = {"QCIF": (144, 120), "CIF": (288, 240), "SD": (576, 480), "HDp": (None, 720), "HDi": (1152, 1080)}
_KHZ = {"HDp": (None, 22.4775, 22.5), "HDi": (31.25, 33.71625, 33.75)}
_PIXELS = {
    "QCIF": {176: 13.5, 180: 13.5}, "CIF": {352: 13.5, 360: 13.5},
    "SD": {512: 9.6, 640: 12.0, 704: 13.5, 720: 13.5, 848: 16.0, 960: 18.0, 1024: 19.2, 1280: 24.0, 1440: 27.0},
    "HDp": {960: 27.84375, 1024: 29.7, 1280: 37.125, 1440: 41.765625, 1920: 55.6875},
    "HDi50": {960: 36.0, 1024: 38.4, 1280: 48.0, 1440: 54.0, 1920: 72.0},
    "HDi": {960: 37.125, 1024: 39.6, 1280: 49.5, 1440: 55.6875, 1920: 74.25},
}
_DEFAULT = {"QCIF": 176, "CIF": 352, "SD": 720, "HDp": 1280, "HDi50": 1440, "HDi": 1920}
SIZES = tuple(_LINES)
#: Width up to which a picture is 4:3 unless told otherwise.
NARROW = {"SD": 720, "CIF": 352, "QCIF": 176}


def raster_rows() -> list[tuple[bool, str, str, int, int, int, float, float]]:
    """stream, freq, size, asked width (0: the default), width, lines, line kHz, pixel MHz; of interlaced pictures."""
    rows = []
    for freq in FREQUENCIES:
        fifty = freq in _FIFTY
        for size, (at50, at60) in _LINES.items():
            lines = at50 if fifty else at60
            if lines is None:
                continue
            khz = _KHZ.get(size, (15.625, 15.734264, 15.75))[0 if fifty else 2 if freq in _EXACT else 1]
            kind = "HDi50" if size == "HDi" and fifty else size
            widths = {0: _DEFAULT[kind], **{w: w for w in _PIXELS[kind]}}
            rows += [(False, freq, size, asked, w, lines, khz, _PIXELS[kind][w]) for asked, w in widths.items()]
    for freq, lines, khz, widths in (("25", 625, 15.625, {864: 13.5, 1024: 16.0, 1152: 18.0}), ("30", 525, 15.734264, {858: 13.5, 1144: 18.0})):
        first = next(iter(widths))
        rows += [(True, freq, "SD", asked, w, lines, khz, widths[w]) for asked, w in {0: first, **{w: w for w in widths}}.items()]
    return rows


#: File data formats: bits of a sample.
DATA_FORMATS = {"B*8 ": 8, "B*10": 10, "B*12": 12, "B*14": 14, "I*2 ": 16, "R*2 ": 16}
#: Memory formats: bits; AF is as in the file.
MEMORY_FORMATS = {"8": 8, "10": 10, "12": 12, "14": 14, "16": 16, "16_LSB": 16, "AF": None}

#: Modes of reading components: what each colour format gives, or the status.
MODES = ("Y", "ALL", "UV", "U", "V", "R", "G", "B")


def component_modes() -> list[tuple[int, str, list[int], int]]:
    """color, mode, components, status."""
    rows = []
    for color in COLORS:
        for mode in MODES:
            if color == 0:
                got = [0] if mode == "Y" else 212 if mode in "RGB" else 211
            elif color in (1, 2):
                got = {"ALL": [0, 1], "Y": [0], "UV": [1], "U": 213, "V": 213}.get(mode, 214)
            elif color in (3, 4, 5):
                got = {"ALL": [0, 1, 2], "Y": [0], "UV": [1, 2], "U": [1], "V": [2]}.get(mode, 214)
            elif color in (6, 8):
                got = {"ALL": [0, 1, 2], "Y": [0, 1, 2], "R": [0], "G": [1], "B": [2]}.get(mode, 215)
            else:
                got = {"ALL": [0], "Y": [0], "UV": 216, "U": 216, "V": 216}.get(mode, 217)
            rows.append((color, mode, got if isinstance(got, list) else [], 0 if isinstance(got, list) else got))
    return rows


STATUS = {
    0: "success", 100: "cannot open the file for reading", 101: "cannot create the file", 102: "cannot open the file for changes", 103: "not a file of this format",
    110: "write error", 111: "read error", 112: "seek error", 113: "backward seek on a stream", 115: "write past the announced images on a stream", 116: "a header on a stream cannot be rewritten", 117: "new header does not fit the data in the file",
    199: "image count too large", 200: "component count too large", 201: "no such component", 202: "image header records are not allowed", 203: "illegal record length", 204: "illegal temporal subsampling", 205: "no such auxiliary entry", 206: "illegal line subsampling", 207: "illegal pixel subsampling",
    210: "needs an interlaced file", 211: "chrominance asked of a luminance-only file", 212: "R, G or B asked of a luminance-only file", 213: "separate U or V asked of a multiplexed file", 214: "R, G or B asked of a Y, U, V file", 215: "chrominance asked of an R, G, B file", 216: "chrominance asked of a stream file", 217: "R, G or B asked of a stream file", 218: "no such component to read", 219: "no such component to write",
    220: "luminance component has a wrong size", 221: "chrominance component has a wrong size", 222: "R, G, B component has a wrong size", 223: "stream component has a wrong size", 224: "X, Y, Z component has a wrong size", 225: "description too long", 226: "extra component has a wrong size", 227: "picture size is no multiple of the subsampling", 228: "auxiliary data too long", 229: "auxiliary headers too long",
    230: "header differs from that in the file", 242: "colour format does not suit multiplexed access", 243: "colour format does not suit planar access", 300: "illegal colour format", 400: "illegal image frequency", 410: "image frequency cannot be changed so", 420: "negative frequency",
    500: "illegal picture size", 501: "illegal interlace factor", 502: "illegal component size", 503: "illegal phase shift", 600: "illegal aspect ratio", 700: "size and frequency do not go together", 701: "size cannot be interlaced", 702: "size cannot be progressive", 703: "stream format cannot be interlaced", 710: "illegal number of pixels in a line",
    800: "illegal file data format", 810: "components differ in data format", 820: "illegal memory data format", 830: "unknown file sample type", 840: "unknown memory sample type", 850: "floats are not IEEE 754 here", 900: "out of memory",
}
#: Codes that nothing raises.
NEVER_RAISED = (115, 202)
MAX_COMPONENTS, MAX_IMAGES, AUX_BYTES, DESCRIPTION_BYTES, RECORD_BYTES = 128, 9_999_999, 16_384, 2048, 512
