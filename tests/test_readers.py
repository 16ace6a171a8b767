"""MAT files made byte by byte, and workbooks as streams."""

import io
import struct
import tracemalloc
import zipfile
import zlib

import numpy as np
import pytest

from plumbline.sources.matrices import variables
from plumbline.sources.tables import read_file

TYPES = {"i1": 1, "u1": 2, "i2": 3, "u2": 4, "i4": 5, "u4": 6, "f4": 7, "f8": 9, "i8": 12, "u8": 13}
CLASSES = {"f8": 6, "f4": 7, "i1": 8, "u1": 9, "i2": 10, "u2": 11, "i4": 12, "u4": 13, "i8": 14, "u8": 15}


def element(kind, raw, order="<"):
    if 0 < len(raw) <= 4:
        return struct.pack(f"{order}I", len(raw) << 16 | kind) + raw.ljust(4, b"\0")
    return struct.pack(f"{order}II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)


def matrix(name, array, kind=None, stored=None, order="<", flags=0, packed=False):
    """A variable; stored: the type that its numbers are written as."""
    code = kind if kind is not None else CLASSES[array.dtype.str[1:]]
    of = stored or array.dtype.str[1:]
    body = element(6, struct.pack(f"{order}II", code | flags, 0), order) + element(5, np.array(array.shape, f"{order}i4").tobytes(), order) + element(1, name.encode(), order)
    body += element(TYPES[of], array.astype(order + of).tobytes("F"), order)
    whole = struct.pack(f"{order}II", 14, len(body)) + body
    squeezed = zlib.compress(whole)
    return struct.pack(f"{order}II", 15, len(squeezed)) + squeezed if packed else whole


def mat(*parts, order="<"):
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(f"{order}HH", 0x0100, 0x4D49) + b"".join(parts)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_numbers_of_all_classes(order, packed):
    rng = np.random.default_rng(3)
    made = {f"v{i}": (rng.random((3, 4)) * 90).astype(t) for i, t in enumerate(CLASSES)} | {"a": np.arange(5.0).reshape(1, 5), "long_name_of_it": np.ones((2, 1)), "none": np.zeros((0, 3)), "deep": np.arange(24.0).reshape(2, 3, 4)}
    parts = [matrix(k, v, order=order, packed=packed) for k, v in made.items()] + [matrix("few", np.array([[1.0, 2.0, 3.0]]), stored="u1", order=order, packed=packed)]
    got = dict(variables(mat(*parts, order=order)))
    assert list(got) == [*made, "few"] and all((got[k] == v).all() and got[k].shape == v.shape and got[k].dtype.kind == v.dtype.kind for k, v in made.items())
    assert got["few"].tolist() == [[1.0, 2.0, 3.0]] and got["few"].dtype == np.float64


def test_rows_and_statuses():
    one = np.array([[1.5, 2.0], [3.0, 4.25]])
    data = mat(matrix("m", one, packed=True), matrix("text", np.array([[104, 105]], "u2"), kind=4), matrix("c", one, kind=1), matrix("s", one, kind=2, packed=True), matrix("z", one, flags=0x0800), matrix("deep", np.ones((2, 2, 2))), matrix("n", np.array([[7]], "i4")))
    rows = list(read_file("/x/a.mat", data, "file"))
    assert [(r[2], r[3], r[4], r[5], r[6], r[7]) for r in rows] == [
        ("m", 0, 0, ["1.5", "2.0"], ["col_1", "col_2"], None), ("m", 0, 1, ["3.0", "4.25"], ["col_1", "col_2"], None),
        *[(k, 0, -1, None, None, "mat_not_numeric") for k in ("text", "c", "s", "z")], ("deep", 0, -1, None, None, "array_not_2d"), ("n", 2, 0, ["7"], ["col_1"], None),
    ]
    assert [r[7] for r in read_file("/x/a.mat", mat(), "file")] == ["mat_no_arrays"]


def test_damaged_files_end_in_an_error():
    whole = mat(matrix("m", np.ones((30, 30))), matrix("n", np.ones((30, 30)), packed=True))
    for data in (whole[:400], whole[:-5], whole[:131], b"mat", whole[:-40] + b"x" * 40, b"\x89HDF".ljust(200)):
        with pytest.raises(ValueError):
            list(variables(data))


_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(sheets, shared=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {_S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>""" for i in range(1, len(sheets) + 1))}</Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {_S}>{''.join(f'<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>' for s in shared)}</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {_S}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_sheets():
    rows = '<row r="2"/><row r="4"><c r="B4" t="s"><v>1</v></c><c t="s"><v>0</v></c></row><row><c r="AA5"><v>7</v></c></row>'
    got = [(r[2], r[3], r[4], r[5]) for r in read_file("a.xlsx", workbook({"blank": '<row r="1"><c r="A1"/></row>', "one": rows, "two": '<row r="1"><c r="A1"><v>1</v></c></row>'}, ["mean", "level"]), "file")]
    assert got == [("one", 0, 0, []), ("one", 0, 1, []), ("one", 0, 2, []), ("one", 0, 3, ["", "level", "mean"]), ("one", 0, 4, [""] * 26 + ["7"]), ("two", 1, 0, ["1"])]


def test_a_large_sheet_is_a_stream():
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}"><v>{i}.5</v></c></row>' for i in range(1, 60_001))
    data = workbook({"s": rows})
    tracemalloc.start()
    n = sum(r[5] == [str(r[4] + 1), f"{r[4] + 1}.5"] for r in read_file("a.xlsx", data, "file"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 12 << 20
