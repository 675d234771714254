import json

import pytest

from entloom import DEFAULT_SCHEMA, EntitySchema, EntityType, load_schema, save_schema


def test_round_trips(tmp_path):
    schema = EntitySchema((EntityType("Drug", "A médicine", ("Aspirin",)), EntityType("Dose", "An amount")), "2")
    for name in ("a.yaml", "a.yml", "a.json"):
        save_schema(schema, tmp_path / name)
        assert load_schema(tmp_path / name) == schema


def test_fingerprint_is_stable_and_sees_order():
    a, b = EntityType("A", "x", ("1", "2")), EntityType("B", "y")
    first = EntitySchema((a, b))
    assert first.fingerprint() == EntitySchema((a, b)).fingerprint() and len(first.fingerprint()) == 16
    others = [EntitySchema((b, a)), EntitySchema((EntityType("A", "x", ("2", "1")), b)), EntitySchema((a, b), "2")]
    assert len({s.fingerprint() for s in [first, *others]}) == 4


def test_lookup():
    assert DEFAULT_SCHEMA.type_names == ["Person", "Organization", "Location"]
    assert DEFAULT_SCHEMA.type_by_name("Person").name == "Person" and DEFAULT_SCHEMA.type_by_name("Nope") is None


@pytest.mark.parametrize("make", [lambda: EntitySchema(()), lambda: EntitySchema((EntityType("A", "x"), EntityType("A", "y"))), lambda: EntityType("", "x"), lambda: EntityType("A", "")])
def test_invalid(make):
    with pytest.raises(ValueError):
        make()


def test_bad_files(tmp_path):
    with pytest.raises(FileNotFoundError):
        load_schema(tmp_path / "none.yaml")
    for name, text in (("a.toml", "x"), ("list.yaml", "- a"), ("list.json", json.dumps([1])), ("extra.json", json.dumps({"types": [], "more": 1}))):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            load_schema(tmp_path / name)


def test_frame(spark):
    rows = DEFAULT_SCHEMA.frame(spark).orderBy("ord").collect()
    assert [r.name for r in rows] == DEFAULT_SCHEMA.type_names
