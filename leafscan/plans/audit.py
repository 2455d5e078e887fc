"""The whole audit as one lazily built set of tables.

The intermediate tables are written once to the shared folder (``session.settle``): the facts of
the two passes over the source text, the raw findings, the units with their call chains, and the
final findings. All later tables read those, so no table causes the text to be read again.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from .. import rulebook as rb
from ..operators import callchain, discovery, enrich, findings as fd, grouping, js_rules, metrics, modules, scoring, text_rules, tokens
from ..session import discard, settle
from ..sources import files as fs


# Two short strings a row: some 100 MB as a hash table in each executor.
BROADCAST_ROWS = 1_000_000


class Audit:
    """Tables of one audit over ``source_files(project, [root,] file_path, content)``.

    ``rules`` replaces the built-in ``(code, category, points)`` table, ``policy`` holds
    ``(project, max_allowed_severity, enforce_strategy)``, ``ignore`` adds path globs.
    """

    def __init__(self, source_files: DataFrame, policy: DataFrame | None = None, rules: DataFrame | None = None,
                 ignore: Iterable[str] = rb.USER_IGNORED_GLOBS, call_chains: bool = True,
                 max_bytes: int | None = None):
        self.source_files = fs.source_files(source_files)
        self.policy, self.rules = policy, rules
        self.ignore, self.with_chains, self.max_bytes = tuple(ignore), call_chains, max_bytes
        self.settled: list[str] = []

    def _settle(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        return settle(df, name, partition_by, self.settled)

    def close(self) -> None:
        """Remove the intermediate tables; tables of this audit can't be read after it."""
        discard(self.source_files.sparkSession, self.settled)
        self.settled.clear()

    def __enter__(self) -> Audit:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # -- files ------------------------------------------------------------------------------
    @cached_property
    def paths(self) -> DataFrame:
        """The source table without its texts, read once for all that looks at paths alone."""
        return self._settle(self.source_files.withColumn("content", F.lit(None).cast("string")), "paths")

    @cached_property
    def backend_roots(self) -> DataFrame:
        """Backend folders by project, from a scan of the paths alone.

        This table meets the text itself, so it is counted: up to the bound it is broadcast and
        the text stays where it is; beyond it the join is a shuffled one with skew handling.
        """
        roots = self._settle(fs.backend_roots(self.paths), "backend_roots")
        return F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots

    @cached_property
    def files(self) -> DataFrame:
        return fs.audited_files(self.source_files, self.ignore, self.backend_roots)

    @cached_property
    def files_scanned(self) -> DataFrame:
        """Number of audited files by project."""
        return fs.files_scanned(fs.audited_files(self.paths, self.ignore, self.backend_roots))

    @cached_property
    def projects(self) -> DataFrame:
        """Every project of the input with its backend root; reads paths only."""
        kept = fs.select_backend_root(self.paths, self.backend_roots)
        return kept.groupBy("project").agg(F.min("root").alias("root"))

    @cached_property
    def project_context(self) -> DataFrame:
        # Hints may lie anywhere in the project, not only below its backend folder.
        orm = fs.orm_tags(fs.ignore_paths(self.paths, self.ignore)).groupBy("project").agg(F.sort_array(F.collect_set("orm")).alias("orm"))
        return self.projects.join(orm, "project", "left").join(self.files_scanned, "project", "left").select(
            "project", F.col("root").alias("backend_root"),
            F.coalesce("orm", F.array().cast("array<string>")).alias("orm"),
            F.coalesce("files_scanned", F.lit(0)).alias("files_scanned"))

    @cached_property
    def bad_files(self) -> DataFrame:
        return fs.unreadable_files(self.source_files, self.max_bytes).unionByName(js_rules.bad_files(self.facts))

    # -- facts of the source text -----------------------------------------------------------
    @cached_property
    def text_facts(self) -> DataFrame:
        return self._settle(text_rules.text_facts(self.files), "text_facts", ("rule_id",))

    @cached_property
    def facts(self) -> DataFrame:
        code = self.files.filter(fs.is_code(F.col("file_path")))
        return self._settle(tokens.token_facts(code, symbols=self.with_chains), "token_facts", ("fact",))

    @cached_property
    def aliases(self) -> DataFrame | None:
        """Path aliases of the projects' ``tsconfig`` files, if the source table has any."""
        found = self._settle(modules.path_aliases(self.source_files), "aliases")
        return None if found.isEmpty() else found

    # -- findings ---------------------------------------------------------------------------
    @cached_property
    def raw_findings(self) -> DataFrame:
        text = text_rules.hit_rows(self.text_facts)
        hits = text.filter("rule_id <> 'A12'").unionByName(js_rules.page_size_hits(text, self.facts)).unionByName(
            js_rules.js_hits(self.facts))
        return self._settle(fd.to_findings(hits), "raw_findings")

    @cached_property
    def final_findings(self) -> DataFrame:
        """Enriched and deduped, before units are assigned."""
        return self._settle(enrich.enrich(self.raw_findings), "final_findings")

    @cached_property
    def discovered(self) -> DataFrame:
        units = discovery.discovered_units(self.facts)
        if self.with_chains:
            units = callchain.call_chains(units, self.facts, self._settle, self.aliases)
        return self._settle(units, "units")

    @cached_property
    def findings(self) -> DataFrame:
        """Final findings with layer, category and unit."""
        return self._settle(
            grouping.group_findings(self.final_findings, self.discovered, self.rules), "findings")

    @cached_property
    def units(self) -> DataFrame:
        return self.discovered.unionByName(grouping.file_units(self.findings, self.projects), allowMissingColumns=True)

    # -- scores -----------------------------------------------------------------------------
    @cached_property
    def code_points(self) -> DataFrame:
        return scoring.code_points(self.findings, self.rules)

    @cached_property
    def unit_scores(self) -> DataFrame:
        # Eight tables read the scores.
        return self._settle(scoring.score_units(self.units, self.findings, self.rules), "unit_scores")

    @cached_property
    def unit_deductions(self) -> DataFrame:
        return scoring.unit_deductions(self.code_points)

    @cached_property
    def unit_categories(self) -> DataFrame:
        return self._settle(scoring.unit_categories(self.code_points), "unit_categories")

    @cached_property
    def project_scores(self) -> DataFrame:
        return scoring.project_scores(self.projects, self.unit_scores)

    @cached_property
    def project_categories(self) -> DataFrame:
        return scoring.project_categories(self.unit_scores, self.unit_categories)

    # -- measures, ranks, advice, decisions ---------------------------------------------------
    @cached_property
    def signals(self) -> DataFrame:
        return enrich.signals(self.raw_findings)

    @cached_property
    def strategies(self) -> DataFrame:
        found = enrich.detected_strategy(self.findings)
        return self.projects.select("project").join(found, "project", "left").select(
            "project", F.coalesce("detected_strategy", F.lit("none")).alias("detected_strategy"))

    @cached_property
    def project_metrics(self) -> DataFrame:
        return metrics.project_metrics(self.projects, self.unit_scores)

    @cached_property
    def top_units(self) -> DataFrame:
        return metrics.top_units(self.unit_scores)

    @cached_property
    def issues(self) -> DataFrame:
        return metrics.issues(self.findings)

    @cached_property
    def root_causes(self) -> DataFrame:
        return metrics.root_causes(self.findings)

    @cached_property
    def recommendations(self) -> DataFrame:
        return metrics.recommendations(self.findings)

    @cached_property
    def next_actions(self) -> DataFrame:
        return metrics.next_actions(self.project_metrics)

    @cached_property
    def hotspots(self) -> DataFrame:
        return metrics.hotspots(self.project_metrics)

    @cached_property
    def gate_violations(self) -> DataFrame:
        return metrics.gate_severity(self.findings, self.policy)

    @cached_property
    def gate_verdicts(self) -> DataFrame:
        return metrics.gate_verdicts(self.projects, self.findings, self.strategies, self.policy)


def audit(source_files: DataFrame, policy: DataFrame | None = None, rules: DataFrame | None = None, **options) -> Audit:
    return Audit(source_files, policy, rules, **options)
