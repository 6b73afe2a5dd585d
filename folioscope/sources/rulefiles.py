"""Rule catalogs and packs from YAML files.

A catalog has the sections rules_a, rules_b, rules_f and rules_u: a rule's key is its id and a name (A01_date_format), its
fields are enabled, level, title, clause and params, of which applies_to and exclude_forms gate forms. A pack has meta, forms,
rules_f and overrides. Files are small and read on the driver; nothing else here touches data.
"""

from __future__ import annotations

import warnings
from dataclasses import replace
from pathlib import Path

from ..operators import classify
from ..operators.page_rules import BUILDERS
from ..plans import catalog as c

SECTIONS = ("rules_a", "rules_b", "rules_f", "rules_u")


def _yaml(path: Path) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("catalog files need PyYAML; catalogs can also be built with catalog.with_packs") from e
    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}


def discovered(path: str) -> list[Path]:
    """The packs beside a catalog: packs/*.yaml, in the order of their names."""
    return sorted(x for x in (Path(path).parent / "packs").glob("*.yaml") if x.is_file())


def _chosen(path: str, packs: str | list[str] | None) -> list[Path]:
    return discovered(path) if packs == "auto" else [Path(x) for x in packs or ()]


def _rules(section: dict | None, where: str) -> dict[str, c.Rule]:
    """Rules of a section; one without code here is left out with a warning."""
    out = {}
    for key, spec in (section or {}).items():
        rule_id = key.split("_", 1)[0]
        if rule_id not in c.BOOK:
            warnings.warn(f"{where}: {key} has no code and never runs", stacklevel=3)
            continue
        bare = replace(c.BOOK[rule_id], include=(), exclude=(), title=key)
        out[rule_id] = c.with_packs({rule_id: bare}, {rule_id: spec or {}})[rule_id]
    return out


def load(path: str, packs: str | list[str] | None = "auto") -> tuple[dict[str, c.Rule], classify.Forms, list[dict]]:
    """The catalog with its packs applied in order, the forms that they know, and the packs' meta fields."""
    raw = _yaml(Path(path))
    book = {r: x for name in SECTIONS for r, x in _rules(raw.get(name), str(path)).items()}
    forms, metas = [], []
    for file in _chosen(path, packs):
        pack = _yaml(file)
        meta = dict(pack.get("meta") or {})
        meta |= {"name": str(meta.get("name") or file.stem), "file": file.name}
        if meta["name"] in {m["name"] for m in metas}:
            raise ValueError(f"two packs are named {meta['name']}")
        metas.append(meta)
        forms.append(classify.forms_of(pack.get("forms") or {}))
        own = _rules(pack.get("rules_f"), meta["name"])
        if twice := own.keys() & book.keys():
            raise ValueError(f"pack {meta['name']} defines {', '.join(sorted(twice))} again; overrides change a rule")
        book = c.with_packs(book | own, {key.split("_", 1)[0]: change or {} for key, change in (pack.get("overrides") or {}).items()})
    return book, classify.DEFAULT.merged(*forms) if forms else classify.DEFAULT, metas


def fingerprint(path: str, packs: str | list[str] | None = "auto") -> str:
    """16 digits over a catalog's bytes and its packs' names and bytes."""
    import hashlib

    h = hashlib.sha256(Path(path).read_bytes() if Path(path).exists() else b"")
    for file in _chosen(path, packs):
        h.update(file.name.encode() + file.read_bytes())
    return h.hexdigest()[:16]


def implemented() -> list[str]:
    """Rules with code: page rules, unit rules and those of the seal model."""
    return sorted({*BUILDERS, "B12", "B13", "U01", "U02", "U03", "U04"})
