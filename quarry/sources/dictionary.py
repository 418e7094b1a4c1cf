"""Keyword dictionary source (S7) and its normalisation (M4).

A dictionary is an ordered ``group -> [keyword]`` mapping.  It is config
sized: it is validated and normalised on the driver, shipped to every task
inside the match closure, and offered as a DataFrame for joins and reports.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The test dictionary (group -> keywords, in this order).
TEST_DICTIONARY = {
    "Credentials": ["token", "password", "token = "],
    "Licensing": ["License", "GNU General Public License", "licensed under"],
    "Contact": ["@", "example.com", "mail5.example.com"],
    "Common": ["the", "tion", "thth", "This"],
    "German": ["auss", "AUSS", "nicht"],
    "Misc": ["token", "license", "intranet"],
}

# Size guard for everything that is shipped whole to each task.
MAX_KEYWORDS = 2_000_000
MAX_KEYWORD_BYTES = 256 * 1024 * 1024

DICT_SCHEMA = T.StructType([
    T.StructField("keyword_group", T.StringType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("norm", T.StringType(), False),
    T.StructField("display", T.StringType(), False),
])


@dataclass(frozen=True)
class NormEntry:
    norm: str
    display: str
    groups: tuple[str, ...]   # sorted


class KeywordDictionary:
    """Validated ``group -> keywords`` with both match normalisations."""

    def __init__(self, groups: dict, *, drop_empty: bool = True):
        if not isinstance(groups, dict):
            raise ValueError("keyword groups must be a mapping of group -> list of keywords")
        entries = []
        total = 0
        for group, keywords in groups.items():
            if not isinstance(keywords, list):
                raise ValueError(f"keywords of group {group!r} must be a list")
            for kw in keywords:
                kw = str(kw)
                if drop_empty and not kw:
                    continue
                entries.append((str(group), kw))
                total += len(kw.encode("utf-8"))
        if not entries:
            raise ValueError("no keywords in dictionary")
        if len(entries) > MAX_KEYWORDS or total > MAX_KEYWORD_BYTES:
            raise ValueError(
                f"dictionary too large to ship to tasks: {len(entries)} keywords, {total} bytes")
        self.entries: list[tuple[str, str]] = entries

    # ------------------------------------------------------------ sources
    @classmethod
    def from_yaml(cls, path: str) -> "KeywordDictionary":
        try:
            import yaml
        except ImportError as e:  # pragma: no cover
            raise RuntimeError("PyYAML is needed to read a YAML keyword config") from e
        with open(path, "r", encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        if not isinstance(data, dict) or not isinstance(data.get("Keyword_Groups"), dict):
            raise ValueError("config must hold a mapping named Keyword_Groups")
        return cls(data["Keyword_Groups"])

    @classmethod
    def from_table(cls, df: DataFrame, group_col: str = "keyword_group",
                   keyword_col: str = "keyword", order_col: str | None = None) -> "KeywordDictionary":
        """Dictionary from any (group, keyword) table; its size is checked before it is fetched."""
        n = df.count()
        if n > MAX_KEYWORDS:
            raise ValueError(f"dictionary table has {n} rows, over the limit of {MAX_KEYWORDS}")
        cols = [F.col(group_col).cast("string"), F.col(keyword_col).cast("string")]
        if order_col:
            df = df.orderBy(order_col)
        groups: dict[str, list[str]] = {}
        for g, k in df.select(*cols).toLocalIterator():
            if g is None or k is None:
                continue
            groups.setdefault(g, []).append(k)
        return cls(groups)

    # ------------------------------------------------------------ views
    @property
    def groups(self) -> list[str]:
        seen = []
        for g, _ in self.entries:
            if g not in seen:
                seen.append(g)
        return seen

    def fingerprint(self, case_sensitive: bool = False, mode: str = "dictionary") -> str:
        blob = json.dumps([mode, case_sensitive, self.entries], ensure_ascii=False)
        return hashlib.sha256(blob.encode("utf-8")).hexdigest()

    @staticmethod
    def fold(s: str, case_sensitive: bool = False) -> str:
        return s if case_sensitive else s.casefold()

    def normalised(self, case_sensitive: bool = False) -> list[NormEntry]:
        """Dictionary mode: one entry per normal form, first spelling is the display."""
        order: list[str] = []
        display: dict[str, str] = {}
        groups: dict[str, set] = {}
        for g, kw in self.entries:
            n = self.fold(kw, case_sensitive)
            if not n:
                continue
            if n not in display:
                display[n] = kw
                order.append(n)
                groups[n] = set()
            groups[n].add(g)
        return [NormEntry(n, display[n], tuple(sorted(groups[n]))) for n in order]

    def boundary_entries(self) -> list[tuple[str, str, str]]:
        """Boundary mode: (group, keyword, lower(keyword)) for every configured pair."""
        out = []
        seen = set()
        for g, kw in self.entries:
            if (g, kw) in seen:
                continue
            seen.add((g, kw))
            out.append((g, kw, kw.lower()))
        return out

    def max_norm_len(self, case_sensitive: bool = False) -> int:
        return max((len(e.norm) for e in self.normalised(case_sensitive)), default=1)

    def to_frame(self, spark: SparkSession, case_sensitive: bool = False) -> DataFrame:
        """``dict(keyword_group, keyword, pos, norm, display)``; pos is the config order."""
        disp = {e.norm: e.display for e in self.normalised(case_sensitive)}
        rows = []
        for pos, (g, kw) in enumerate(self.entries):
            n = self.fold(kw, case_sensitive)
            rows.append((g, kw, pos, n, disp.get(n, kw)))
        return spark.createDataFrame(rows, DICT_SCHEMA)


def dictionary_norm(dict_df: DataFrame) -> DataFrame:
    """M4 as a DataFrame job: per normal form, its groups and first spelling."""
    return (dict_df.where(F.col("norm") != "")
            .groupBy("norm")
            .agg(F.array_sort(F.collect_set("keyword_group")).alias("groups"),
                 F.min_by("keyword", "pos").alias("display")))
