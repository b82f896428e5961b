import os

import pytest

from tessera.config import CsvFormatError, DatasetError
from tessera.sources.csv import CsvOptions, load_csv, structure_audit, read_header


def write(folder, name, data: bytes):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_load_semicolon_latin1_with_types(spark, scratch):
    path = write(scratch, "cities.csv", "city;target;when\nZürich;1;2024-01-02\nGenève;0;2024-02-03\n".encode("latin-1"))
    df, spec = load_csv(spark, path, target="target", options=CsvOptions(encoding="latin-1", delimiter=";"))
    assert df.columns == ["city", "target", "when"]
    assert dict(df.dtypes) == {"city": "string", "target": "int", "when": "string"}
    assert sorted(r["city"] for r in df.collect()) == ["Genève", "Zürich"]
    assert spec.fingerprint and spec.target == "target"


def test_bom_and_infinity_parse(spark, scratch):
    path = write(scratch, "bom.csv", "﻿x,target\n1.5,a\ninf,b\n".encode("utf-8"))
    df, _ = load_csv(spark, path, target="target")
    assert df.columns == ["x", "target"] and dict(df.dtypes)["x"] == "double"


@pytest.mark.parametrize("text,match", [
    ("a,,c\n1,2,3\n", "blank"),
    ("a,a\n1,2\n", "duplicate"),
    ("a,b\n1,2\n3\n", "too few"),
    ("a,b\n1,2\n3,4,5\n", "too many"),
    ("a,b\n", "no data"),
])
def test_malformed_csv_rejected(spark, scratch, text, match):
    path = write(scratch, "bad.csv", text.encode())
    with pytest.raises(CsvFormatError, match=match):
        load_csv(spark, path, target="a")


def test_bad_utf8_and_size_and_target(spark, scratch):
    path = write(scratch, "enc.csv", b"a,b\n\xff\xfe,1\n")
    with pytest.raises(CsvFormatError, match="UTF-8"):
        load_csv(spark, path, target="a")
    good = write(scratch, "ok.csv", b"a,b\n1,2\n")
    with pytest.raises(CsvFormatError, match="limit"):
        load_csv(spark, good, target="a", options=CsvOptions(max_file_size_bytes=3))
    with pytest.raises(DatasetError, match="available"):
        load_csv(spark, good, target="zzz")
    with pytest.raises(CsvFormatError):
        CsvOptions(delimiter=";;")


def test_structure_audit_counts(spark, scratch):
    path = write(scratch, "rag.csv", b"a,b\n1,2\n3\n4,5,6\n7,8\n")
    header = read_header(spark, path, CsvOptions())
    reasons = {r["reason"]: r["rows"] for r in structure_audit(spark, path, header, CsvOptions()).collect()}
    assert reasons == {"too few fields": 1, "too many fields": 1}


def test_folder_of_files_headers_checked_per_file(spark, scratch):
    folder = os.path.join(scratch, "parts")
    os.makedirs(folder)
    write(folder, "a.csv", b"x,target\n1,a\n2,b\n")
    write(folder, "b.csv", b"x,target\n3,a\n")
    df, _ = load_csv(spark, folder, target="target")
    assert df.count() == 3
    write(folder, "c.csv", b"y,target\n4,b\n")
    with pytest.raises(CsvFormatError, match="different header"):
        load_csv(spark, folder, target="target")


def test_encoding_audit_is_line_exact(spark, scratch):
    from tessera.sources.csv import encoding_audit

    path = write(scratch, "bad.csv", b"a,b\n\xff\xfe,1\n")
    assert encoding_audit(spark, path).count() == 1
    ok = write(scratch, "fine.csv", "a,b\nZürich,\ufffd\n".encode())
    assert encoding_audit(spark, ok).count() == 0


def test_explicit_schema_skips_inference(spark, scratch):
    path = write(scratch, "typed.csv", b"x,target\n1.5,a\n2.5,b\n")
    df, _ = load_csv(spark, path, target="target", schema="x double, target string")
    assert dict(df.dtypes) == {"x": "double", "target": "string"} and df.count() == 2


def test_quotes_backslashes_and_missing_tokens(spark, scratch):
    text = 'note,n,target\n"say ""hi"", ok",1.5,a\n"ends in \\",NA,b\nplain,nan,a\n"a,b",2.5,b\n'
    path = write(scratch, "quoted.csv", text.encode())
    df, _ = load_csv(spark, path, target="target")
    assert dict(df.dtypes) == {"note": "string", "n": "double", "target": "string"}
    rows = {(r["note"], r["n"]) for r in df.collect()}
    assert rows == {('say "hi", ok', 1.5), ("ends in \\", None), ("plain", None), ("a,b", 2.5)}


def test_quoted_line_break_needs_multiline(spark, scratch):
    path = write(scratch, "broken.csv", b'note,target\n"two\nlines",a\none,b\n')
    with pytest.raises(CsvFormatError):
        load_csv(spark, path, target="target")
    df, _ = load_csv(spark, path, target="target", options=CsvOptions(multiline=True))
    assert sorted(r["note"] for r in df.collect()) == ["one", "two\nlines"]


def test_pipe_delimiter_names_short_rows(spark, scratch):
    path = write(scratch, "pipe.csv", b"a|b\n1|2\n3\n")
    with pytest.raises(CsvFormatError, match="too few"):
        load_csv(spark, path, target="a", options=CsvOptions(delimiter="|"))


def test_bytes_outside_a_declared_encoding(spark, scratch):
    path = write(scratch, "ascii.csv", b"a,b\n1,caf\xe9\n")
    with pytest.raises(CsvFormatError, match="US-ASCII"):
        load_csv(spark, path, target="a", options=CsvOptions(encoding="ascii"))
    df, _ = load_csv(spark, path, target="a", options=CsvOptions(encoding="latin-1"))
    assert df.first()["b"] == "café"


def test_types_come_from_every_value(spark, scratch):
    path = write(scratch, "types.csv", b"i,l,d,t,x\n1,1,1,true,1d\n2,9999999999,2.5e3,False,2\n,,.5,,3\n")
    df, _ = load_csv(spark, path, target="i")
    assert dict(df.dtypes) == {"i": "int", "l": "bigint", "d": "double", "t": "boolean", "x": "string"}
