"""Carriers' rules as data (S14): a folder with a folder for each carrier, read through Spark, as tables.

    carriers/<carrier>/carrier.yaml            names, aliases, patterns of file names and accounts, signals, how documents are merged
    carriers/<carrier>/formats/<format>.yaml   a format's signature, sections and fields
    carriers/<carrier>/domain_knowledge/*.yaml, prompts/*.md

Rules are few and small whatever the inventory's size: the driver parses them and hands them on as rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import MergeRules

#: Roles by their names in the files.
ROLES = {"primary": "base", "enrichment": "enrichment", "supplemental": "supplemental"}


def _parsed(text: str) -> dict:
    try:
        import yaml
    except ImportError:  # then files are JSON, which is YAML, too
        import json

        return json.loads(text) or {}
    return yaml.safe_load(text) or {}


@dataclass
class ConfigStore:
    """Read when first asked; reload() forgets what was read."""

    spark: SparkSession
    path: str

    @cached_property
    def files(self) -> dict[tuple[str, ...], str]:
        """Texts by their path below carriers/."""
        rows = self.spark.read.text(f"{self.path.rstrip('/')}/carriers", wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{yaml,md}")
        found = rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"/carriers/(.+)$", 1).alias("path"), "value").collect()
        return {tuple(r["path"].split("/")): r["value"] for r in sorted(found, key=lambda r: r["path"])}

    def reload(self) -> None:
        for name in ("files", "carriers"):
            self.__dict__.pop(name, None)

    @cached_property
    def carriers(self) -> dict[str, dict]:
        return {p[0]: _parsed(t) for p, t in self.files.items() if p[1:] == ("carrier.yaml",)}

    def _below(self, carrier: str, folder: str, suffix: str) -> dict[str, str]:
        return {p[2].removesuffix(suffix): t for p, t in self.files.items() if len(p) == 3 and p[:2] == (carrier, folder) and p[2].endswith(suffix)}

    def formats(self, carrier: str) -> dict[str, dict]:
        return {n: _parsed(t) for n, t in self._below(carrier, "formats", ".yaml").items()}

    def knowledge(self, carrier: str) -> dict[str, dict]:
        return {n: _parsed(t) for n, t in self._below(carrier, "domain_knowledge", ".yaml").items()}

    def prompt(self, carrier: str, name: str) -> str | None:
        return self._below(carrier, "prompts", ".md").get(name)

    def registry(self) -> DataFrame:
        """key, display, aliases, position: for match_names."""
        rows = [(k, c.get("name") or k, list(c.get("aliases") or []), i) for i, (k, c) in enumerate(self.carriers.items())]
        return self.spark.createDataFrame(rows, "key string, display string, aliases array<string>, position int")

    def filename_patterns(self) -> DataFrame:
        """carrier, doc_type, pattern, confidence, position: for by_filename."""
        rows = [(k, kind, ("(?i)" if p.get("case_insensitive") else "") + p["pattern"], float(p.get("confidence", 0.8))) for k, c in self.carriers.items() for kind, ps in (c.get("filename_patterns") or {}).items() for p in ps or []]
        return self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "carrier string, doc_type string, pattern string, confidence double, position int")

    def signals(self) -> list[tuple[str, list[str], list[tuple[str, str]]]]:
        """For by_content."""
        out = []
        for k, c in self.carriers.items():
            s = c.get("first_page_signals") or {}
            if s.get("required_any"):
                out.append((k, list(s["required_any"]), [(kind, m) for kind, ms in (s.get("doc_type_markers") or {}).items() for m in ms or []]))
        return out

    def merge_rules(self, carrier: str | None) -> MergeRules:
        """A carrier's, or the defaults."""
        m = (self.carriers.get(carrier or "") or {}).get("merge_rules") or {}
        account, phone = m.get("account_normalization") or {}, m.get("phone_normalization") or {}
        own = {"equivalence": list(m["account_equivalence_fields"])} if m.get("account_equivalence_fields") else {}
        return MergeRules(
            roles={k: ROLES.get(v, v) for k, v in (m.get("doc_type_roles") or {}).items()}, canonical=account.get("canonical_length"), check_digit=account.get("check_digit_position") == "trailing",
            with_sub_account=m.get("sub_account_in_merge_key", True), pad_phones=bool(phone.get("pad_short_phones", False)), priorities=m.get("field_priority_overrides") or {},
            base_order=m.get("doc_type_priority_overrides") or {}, non_propagating=list(m.get("non_propagating_fields") or []), extra_propagation=list(m.get("extra_propagation_fields") or []), **own)

    def carrier_by_alias(self, text: str) -> str | None:
        """The first carrier one of whose aliases the text holds."""
        low = text.lower()
        return next((k for k, c in self.carriers.items() if any(a.lower() in low for a in c.get("aliases") or [])), None)

    def format_of(self, carrier: str, text: str) -> str | None:
        """J19 on a text at hand: the first format whose signature fits."""
        import re

        has = lambda p: re.search(p, text, re.IGNORECASE) is not None
        for name, f in self.formats(carrier).items():
            s = f.get("signature") or {}
            required, some = s.get("required_patterns") or [], s.get("any_of_patterns") or []
            if all(map(has, required)) and (not some or any(map(has, some))):
                return name
        return None

    def unavailable(self, carrier: str) -> dict[str, list[str]]:
        """For without_unavailable."""
        return {n: list((f.get("extractable_fields") or {}).get("not_available") or []) for n, f in self.formats(carrier).items()}
