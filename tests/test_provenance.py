"""Loader facts of binaries, and edges of the operators of provenance."""

import struct

from faktum.operators import provenance as P
from faktum.sources.binaries import macho


def _macho(entry: int, crypt: int) -> dict[str, float]:
    segment = lambda name, va, size, rights: struct.pack("<II16sQQQQIIII", 0x19, 72, name, va, size, 0, 0, rights, rights, 0, 0)
    commands = [
        segment(b"__PAGEZERO", 0, 0x1000, 0), segment(b"__DATA", 0x4000, 0x1000, 3), struct.pack("<IIQQ", 0x80000028, 24, entry, 0), struct.pack("<IIIIII", 0x2C, 24, 0, 0, crypt, 0),
        struct.pack("<IIII", 0x29, 16, 0, 24), struct.pack("<IIII", 0x80000034, 16, 0, 0), struct.pack("<IIII", 0x24, 16, 0, 0),
    ]
    body = b"".join(commands)
    data = struct.pack("<IIIIIIII", 0xFEEDFACF, 7, 3, 2, len(commands), len(body), 0, 0) + body
    return {x["name"]: x["value"] for x in macho(data) if x["view"] == "metric"}


def test_load_commands():
    own = _macho(0x10, 1)
    assert {k: own.get(f"macho.{k}") for k in ("has_main_command", "has_encrypted_section", "data_in_code_count", "has_chained_fixups", "uses_legacy_version_min")} == {"has_main_command": 1, "has_encrypted_section": 1, "data_in_code_count": 3, "has_chained_fixups": 1, "uses_legacy_version_min": 1}
    assert "macho.entry_outside_segments" not in own and "macho.has_dyld_info_legacy" not in own  # inside the page of zeros
    assert "macho.has_encrypted_section" not in _macho(0x10, 0)
    assert _macho(0x4010, 0)["macho.entry_in_writable_segment"] == 1 and _macho(0x9000, 0)["macho.entry_outside_segments"] == 1


def test_arrays_of_functions():
    from faktum.sources.binaries import elf

    dynamic = b"".join(struct.pack("<qQ", *x) for x in ((27, 24), (28, 8), (33, 0), (0, 0)))
    head = struct.pack("<4sBBBBB7xHHIQQQIHHHHHH", b"\x7fELF", 2, 1, 1, 0, 0, 3, 62, 1, 0, 0, 64 + len(dynamic), 0, 64, 56, 0, 64, 2, 0)
    data = head + dynamic + bytes(64) + struct.pack("<IIQQQQIIQQ", 0, 6, 0, 0, 64, len(dynamic), 0, 0, 8, 16)
    own = {x["name"]: x["value"] for x in elf(data) if x["view"] == "metric"}
    assert (own["elf.init_array_count"], own["elf.fini_array_count"], "elf.preinit_array_count" in own) == (3, 1, False)


def test_empty_and_null(spark):
    none = lambda ddl: spark.createDataFrame([], ddl)
    assert P.build_path(none("file_id int, ord int, path string, source string")).count() == 0
    assert P.recipe_summary(P.recipe_fields(spark.createDataFrame([(1, None), (2, "")], "file_id int, text string"))).count() == 0
    assert P.overlays(spark.createDataFrame([(1, None), (2, b"")], "file_id int, content binary"), spark.createDataFrame([(1, 0, 0), (2, 0, 9)], "file_id int, start long, size long")).count() == 0
    assert P.superseded(none("name string"), 3).count() == 0
