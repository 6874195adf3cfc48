import json
import struct

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark import ledger as L
from tidemark.functions.msgpack import payload_json, to_json
from tidemark.history import Field, History
from tidemark.operators import upgrade
from tidemark.shapes import BYTES, F64, I64, STRING, U128, list_of

VALUES = History.declare("values", Field("name", STRING), Field("wide", U128), Field("data", BYTES), Field("items", list_of(I64)), Field("x", F64))
LIST = [VALUES]


def text(s):
    raw = s.encode()
    return bytes([0xA0 | len(raw)]) + raw


def packed(wide=(2**128 - 1).to_bytes(16, "big"), tail=b"", again=b""):
    body = text("name") + text("é") + text("wide") + bytes([0xC4, len(wide)]) + wide + text("data") + b"\xc4\x02\x00\xff"
    body += text("items") + b"\x93\x01\xff\xd3" + struct.pack(">q", -(2**63)) + text("x") + b"\xcb" + struct.pack(">d", 0.1) + again
    return bytes([0x80 | (5 + bool(again))]) + body + tail


def test_messagepack_rows(spark):
    rows = [packed(), packed(tail=b"\x00"), packed(wide=b"\x01"), packed(again=text("name") + text("b")), b"\x95\x01\x01\x01\x01\x01", b"", None]
    df = spark.createDataFrame([(n, 1, None if r is None else bytearray(r)) for n, r in enumerate(rows)], "n int, version long, raw binary")
    df = df.withColumn("payload", payload_json(F.col("raw"), F.col("version"), VALUES))
    out = upgrade(df, VALUES, keep=["n"]).orderBy("n").collect()
    first = out[0]["record"]
    assert (first["name"], first["wide"], bytes(first["data"]), first["items"], first["x"]) == ("é", str(2**128 - 1), b"\x00\xff", [1, -1, -(2**63)], 0.1)
    assert [r["error"] and r["error"]["kind"] for r in out[1:]] == ["Decode"] * 6


@pytest.mark.parametrize("data", [b"\xc1", b"\xcb" + struct.pack(">d", float("inf")), b"\x81\x01\x01", b"\x92\x01", b"\xa5ab", b"\x91" * 300 + b"\x01"])
def test_what_has_no_json_form(data):
    assert to_json(data, {}) is None


def test_commands(spark, tmp_path, capsys):
    path = str(tmp_path / "ledger.json")
    here = ["--ledger", path, "--histories", f"{__name__}:LIST"]
    assert cli.main(["init", "--ledger", path]) == 0
    assert cli.main(["init", "--ledger", path]) == 2
    assert cli.main(["check", *here]) == 0 and "draft" in capsys.readouterr().err
    assert cli.main(["check", *here, "--release"]) == 2
    assert cli.main(["freeze", *here]) == 0
    assert cli.main(["check", *here, "--release"]) == 0
    assert cli.main(["reset", "--ledger", path, "values", "1"]) == 0
    assert cli.main(["freeze", *here]) == 2
    assert cli.main(["freeze", *here, "--only", "values@1"]) == 0
    other = str(tmp_path / "other.json")
    L.init(other)
    assert cli.main(["import", "--ledger", other, "--histories", f"{__name__}:LIST", "--from", path]) == 0
    assert cli.main(["check", *here, "--released-baseline", path]) == 2
    LIST[0] = History.declare("values", Field("name", I64))
    try:
        capsys.readouterr()
        assert cli.main(["check", *here, "--format", "json", "--released-baseline", other]) == 2
        report = json.loads(capsys.readouterr().out)
        assert report["ok"] is False and {d["code"] for d in report["diagnostics"]} == {"shape_kind_changed", "field_missing"}
    finally:
        LIST[0] = VALUES
