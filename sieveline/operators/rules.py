"""Rule packs: loading, checking, gating by language, framework and path, syntax queries and whole-file text rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import glob_regex
from sieveline.operators import literals
from sieveline.schema import CONFIDENCES, SEVERITIES, as_findings
from sieveline.syntax.query import Query, QueryError

#: The languages of rules; `scripts` stands for the first three.
SCRIPTS, LANGUAGES = ("javascript", "typescript", "tsx"), ("javascript", "typescript", "tsx", "python")
#: Frameworks that a rule may ask for.
FRAMEWORKS = ("express", "nextjs", "fastapi", "flask")
#: Where the packs of this library are.
PACKS = Path(__file__).parent.parent / "packs"


class PackError(ValueError):
    """A rule pack that cannot be used."""


@dataclass(frozen=True)
class Matcher:
    """One way to match: a syntax query for languages, a pattern for files of a glob, or the shapes of secrets."""

    languages: tuple[str, ...] = ()
    query: str = ""
    file_glob: str = ""
    text_pattern: str = ""
    secret: bool = False


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    confidence: str = "medium"
    languages: tuple[str, ...] = ()
    frameworks: tuple[str, ...] = ()
    path_glob: tuple[str, ...] = ()
    text_pattern: str = ""
    message: str = ""
    remediation: str = ""
    refs: tuple[str, ...] = field(default=())
    description: str = ""
    matchers: tuple[Matcher, ...] = ()

    def __post_init__(self):
        if self.severity not in [s for s, _, _ in SEVERITIES] or self.confidence not in [c for c, _ in CONFIDENCES]:
            raise PackError(f"rule {self.id}: unknown severity or confidence")
        if "/" not in self.id:
            raise PackError(f"rule {self.id}: an id is pack/name")


#: A pack for the test tables, with languages and paths as they occur there.
EXAMPLE_PACK = (
    Rule("text/token-literal", "high", "high", text_pattern='token = "[0-9a-f]{40}"', message="a token is written out"),
    Rule("text/license-line", "info", "high", languages=("en", "de"), text_pattern="License", message="a license is named"),
    Rule("text/symbol-run", "low", "medium", path_glob=("src{1,2}/*.txt",), text_pattern="[#*$%&|<>]{3}", message="a run of symbols"),
    Rule("text/framework-only", "medium", "low", frameworks=("django",), text_pattern="the", message="needs a framework"),
)


def _spelled(languages: list[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x for name in languages for x in (SCRIPTS if name == "scripts" else (name,))))


def _matcher(rule: str, raw: dict, languages: tuple[str, ...]) -> Matcher:
    known = {"language", "languages", "query", "file_glob", "text_pattern", "secret"}
    if set(raw) - known:
        raise PackError(f"rule {rule}: unknown fields of a matcher {sorted(set(raw) - known)}")
    shapes = [bool(raw.get("query")), bool(raw.get("text_pattern")), bool(raw.get("secret"))]
    if sum(shapes) != 1 or bool(raw.get("file_glob")) != shapes[1]:
        raise PackError(f"rule {rule}: a matcher is a query, a file_glob with a text_pattern, or secret")
    named = raw.get("languages") or ([raw["language"]] if raw.get("language") else None)
    own = _spelled(named) if named else languages
    if shapes[0]:
        try:
            Query(raw["query"])
        except QueryError as e:
            raise PackError(f"rule {rule}: {e}") from None
    return Matcher(own if shapes[0] else (), raw.get("query", ""), raw.get("file_glob", ""), raw.get("text_pattern", ""), bool(raw.get("secret")))


def load_pack(folder: str) -> tuple[Rule, ...]:
    """Rules of a folder's YAML files, a rule or a list of them each; unknown fields, doubled ids and unreadable queries are errors."""
    import yaml

    out: dict[str, Rule] = {}
    for path in sorted(Path(folder).glob("*.y*ml")):
        raw = yaml.safe_load(path.read_text(encoding="utf-8"))
        for item in raw if isinstance(raw, list) else [raw]:
            unknown = set(item) - set(Rule.__dataclass_fields__) - {"fixtures"}
            if unknown:
                raise PackError(f"{path.name}: unknown fields {sorted(unknown)}")
            item = {k: v for k, v in item.items() if k != "fixtures"}
            languages = _spelled(item.get("languages", []))
            if item.get("matchers"):
                odd = set(languages) - set(LANGUAGES) | set(item.get("frameworks", [])) - set(FRAMEWORKS)
                if odd:
                    raise PackError(f"rule {item.get('id')}: unknown languages or frameworks {sorted(odd)}")
            matchers = tuple(_matcher(item.get("id", "?"), m, languages) for m in item.get("matchers", []))
            rule = Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in item.items()} | {"languages": languages, "matchers": matchers})
            if rule.id in out:
                raise PackError(f"rule {rule.id} stands twice")
            out[rule.id] = rule
    return tuple(out.values())


def shipped() -> tuple[Rule, ...]:
    """The rules that come with this library."""
    return load_pack(str(PACKS))


def register_rule_pack(folder: str) -> tuple[tuple[Rule, ...], list[str]]:
    """The shipped rules with those of a folder, which win by id; and the ids that they replace."""
    return override(shipped(), load_pack(folder))


def override(base: tuple[Rule, ...], own: tuple[Rule, ...]) -> tuple[tuple[Rule, ...], list[str]]:
    """base with the rules of own, which win by id; and the ids that they replace."""
    by_id = {r.id: r for r in base}
    replaced = [r.id for r in own if r.id in by_id]
    return tuple((by_id | {r.id: r for r in own}).values()), replaced


def pack_frame(spark: SparkSession, pack: tuple[Rule, ...]) -> DataFrame:
    """A pack as a table, with its globs as regular expressions; a row for each text pattern, or one for a rule without any."""
    rows = []
    for r in pack:
        texts = [(m.file_glob, m.text_pattern) for m in r.matchers if m.text_pattern] or [("", r.text_pattern)]
        for glob, pattern in texts:
            rows.append((r.id, r.severity, r.confidence, list(r.languages), list(r.frameworks), [glob_regex(g) for g in r.path_glob], glob_regex(glob) if glob else "", pattern, r.message, r.remediation, r.description))
    return spark.createDataFrame(rows, "rule_id string, severity string, confidence string, languages array<string>, frameworks array<string>, globs array<string>, file_glob string, text_pattern string, message string, remediation string, description string")


def syntax_rules(pack: tuple[Rule, ...], frameworks: list[str] = ()) -> list[tuple[str, list[str], list[str], str]]:
    """(id, languages, path patterns, query) of the syntax matchers that the frameworks let through, for code.extract()."""
    out = []
    for r in pack:
        if not r.frameworks or set(r.frameworks) & set(frameworks):
            out += [(r.id, [x for x in m.languages if x in r.languages], [glob_regex(g) for g in r.path_glob], m.query) for m in r.matchers if m.query]
    return out


def secret_rules(pack: tuple[Rule, ...]) -> list[Rule]:
    return [r for r in pack if any(m.secret for m in r.matchers)]


def _fits(frameworks: list[str]):
    detected = F.array(*map(F.lit, frameworks)).cast("array<string>")
    return (
        ((F.size("languages") == 0) | F.array_contains("languages", F.col("lang")))
        & ((F.size("frameworks") == 0) | F.arrays_overlap("frameworks", detected))
        & ((F.size("globs") == 0) | F.exists("globs", lambda g: F.regexp_like(F.col("path"), g)))
    )


def gate(files: DataFrame, pack: DataFrame, frameworks: list[str]) -> DataFrame:
    """Files with the rules that apply to them. A pack is a list written by people, held by the driver, so it is broadcast."""
    return files.join(F.broadcast(pack), _fits(frameworks), "inner")


#: Patterns from which on a pass for their required strings comes first.
MANY_PATTERNS = 8


def _may_match(files: DataFrame, pack: DataFrame, fits) -> DataFrame:
    """files with the text rules that apply and may match. Of many patterns, one pass over a text says which; of few, all may."""
    own = pack.collect()  # a pack is written by people
    if len(own) < MANY_PATTERNS:
        return files.join(F.broadcast(pack), fits, "inner")
    indexed = files.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(own)], "candidate int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pack.schema.fields))
    may = literals.candidates(files, [r["text_pattern"] for r in own]).select("*", F.explode("candidates").alias("candidate")).drop("candidates")
    return may.join(F.broadcast(indexed), "candidate").where(fits).drop("candidate")


def text_hits(files: DataFrame, pack: DataFrame, frameworks: list[str]) -> DataFrame:
    """Files with the text rules that match them, one row for each."""
    return _may_match(files, pack.where("text_pattern <> ''"), _fits(frameworks)).where(F.regexp_like("text", F.col("text_pattern")))


def whole_file_hits(files: DataFrame, pack: DataFrame, frameworks: list[str]) -> DataFrame:
    """Files of any kind with the text matchers that match them: file glob, framework and rule glob gate, then the pattern; one row for a rule."""
    detected = F.array(*map(F.lit, frameworks)).cast("array<string>")
    fits = (
        F.regexp_like(F.col("path"), F.col("file_glob"))
        & ((F.size("frameworks") == 0) | F.arrays_overlap("frameworks", detected))
        & ((F.size("globs") == 0) | F.exists("globs", lambda g: F.regexp_like(F.col("path"), g)))
    )
    hits = _may_match(files, pack.where("text_pattern <> '' and file_glob <> ''"), fits)
    return hits.where(F.regexp_like("text", F.col("text_pattern"))).dropDuplicates(["path", "rule_id"])


def text_findings(hits: DataFrame) -> DataFrame:
    """Findings of whole_file_hits(): of the file, without a line."""
    return as_findings(
        hits, id=F.col("rule_id"), command=F.split_part(F.col("rule_id"), F.lit("/"), F.lit(1)), severity=F.col("severity"), confidence=F.col("confidence"), file=F.col("path"), message=F.col("message"),
        detail=F.when(F.col("confidence") != "high", F.col("description")), remediation=F.col("remediation"), fixable=False, seed_kind="message_fallback", seed_text=F.col("message"),
    )


def sql_gates(pack: tuple[Rule, ...], frameworks: list[str]) -> list[tuple[str, str, str, str]]:
    """(id, severity, condition, pattern) of each rule for DuckDB."""
    out = []
    for r in pack:
        terms = ["true"]
        if r.languages:
            terms.append("lang IN (" + ", ".join(f"'{v}'" for v in r.languages) + ")")
        if r.frameworks and not set(r.frameworks) & set(frameworks):
            terms.append("false")
        if r.path_glob:
            terms.append("(" + " OR ".join(f"regexp_matches(path, '{glob_regex(g)}')" for g in r.path_glob).replace("\\A", "^").replace("\\z", "$") + ")")
        out.append((r.id, r.severity, " AND ".join(terms), r.text_pattern))
    return out
