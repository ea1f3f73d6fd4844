"""Command line: ``score`` (the default), ``fix``, ``advise``, ``check-prompts``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from skarn.functions import pycode
from skarn.operators import fix, prompts, report, scoring
from skarn.plans import analysis
from skarn.session import session
from skarn.sources import models, repo

COMMANDS = ("score", "fix", "advise", "check-prompts")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skarn")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("score")
    s.add_argument("path", nargs="?", default=".")
    s.add_argument("--agent", default="generic")
    s.add_argument("--fix", action="store_true", help="create missing documents first, and rewrite files if a model is named")
    s.add_argument("--model", help="a language model for rewrites")
    s.add_argument("--tokens", default="chars4", help="a .tiktoken file or the name of a vocabulary; by default a quarter of the characters")
    s.add_argument("--fail-under", type=float, default=scoring.PASS_MARK)
    s.add_argument("--report")
    s.add_argument("--report-style", choices=["full", "actionable", "collapsed"], default="full")
    s.add_argument("--badge")
    s.add_argument("--sort", choices=["acl", "loc", "complexity", "score", "tokens", "types"], default="acl")
    s.add_argument("--top", type=int)
    s.add_argument("--limit-to", action="append")
    s.add_argument("--diff", action="store_true")
    s.add_argument("--diff-base", default="origin/main")
    s.add_argument("--verbosity", choices=["quiet", "summary", "detailed"], default="summary")
    f = sub.add_parser("fix")
    f.add_argument("path", nargs="?", default=".")
    f.add_argument("--agent", default="generic")
    f.add_argument("--model", help="a language model; without one, violations are only listed")
    a = sub.add_parser("advise")
    a.add_argument("path", nargs="?", default=".")
    a.add_argument("--output")
    c = sub.add_parser("check-prompts")
    c.add_argument("path")
    return p


def score(spark, o) -> int:
    limit = o.limit_to
    if o.diff:
        changed = spark.createDataFrame([(c,) for c in repo.changed_files(o.path, o.diff_base)], "path string")
        limit = [r["path"] for r in fix.changed(changed, "path", limit).orderBy("path").toLocalIterator()]
    if o.fix:
        repair(spark, o.path, o.agent, o.model)
    a = analysis.perform_analysis(spark, o.path, o.agent, limit, report_style=o.report_style, tokens=o.tokens)
    if o.verbosity != "quiet":
        print(report.environment_table(a.health, analysis.directory_entropy(spark, o.path), analysis.critical_context(spark, o.path, analysis.token_counter(o.tokens))))
        for issue in a.project_issues:
            print(issue)
        shown = report.visible(a.results, o.verbosity).orderBy("file")
        for r in shown.select("file", "score", "issues").toLocalIterator():
            print(f"{r['file']}: {r['score']} {r['issues']}")
        by = {"types": "type_coverage", "tokens": "tokens", "score": "score"}.get(o.sort)
        rows = a.results.orderBy(F.desc(by)) if by else a.units.orderBy(F.desc(o.sort))
        for r in rows.limit(o.top or 10).toLocalIterator():
            print(f"  {r[by or 'name']} {r['file'] if by else r['rel_path']}")
    print(f"Final Agent Score: {a.final_score:.1f}/100")
    for target, text in ((o.report, lambda: analysis.full_report(a, o.path, o.agent, o.report_style)), (o.badge, lambda: report.badge(a.final_score))):
        if target:
            with open(target, "w", encoding="utf-8") as f:
                f.write(text())
    return int(a.final_score < o.fail_under)


def repair(spark, path: str, agent: str, model: str | None, generate=None) -> list[str]:
    """Create missing documents; with a model, rewrite Python files that have violations. The paths written."""
    made = fix.create_missing(path, agent)
    generate = generate or (models.Model(model) if model else None)
    if generate:
        files = repo.python_files(spark, path)
        units = analysis.inline(pycode.facts(files.where("content is not null")))
        made += fix.apply_rewrites(path, fix.rewrites(files, units, generate).where("rewritten is not null").toLocalIterator())
    return made


def run_fix(spark, o) -> int:
    """Create missing documents, rewrite if a model is named, and list what is left."""
    for name in repair(spark, o.path, o.agent, o.model):
        print(f"created {name}" if not name.endswith(".py") else f"rewrote {name}")
    a = analysis.perform_analysis(spark, o.path, o.agent)
    for r in fix.violations(a.units.where(F.col("rel_path").endswith(".py"))).orderBy("rel_path", "lineno").toLocalIterator():
        print(f"{r['rel_path']}:{r['lineno']} {r['name']} ACL {r['acl']:.1f} typed {r['is_typed']}")
    return 0


def advise(spark, o) -> int:
    a = analysis.perform_analysis(spark, o.path)
    text = report.advisor_report(a.file_rows(), a.god_modules, {d["path"]: d["file_count"] for d in a.directory_stats}, analysis.cycle_lists(a))
    if o.output:
        with open(o.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 0


def check_prompts(spark, o) -> int:
    with open(o.path, encoding="utf-8") as f:
        rows = spark.createDataFrame([(o.path, f.read())], "name string, text string")
    row = prompts.lint(rows, "name", "text").first().asDict(recursive=True)
    print(prompts.lint_report(o.path, row))
    return int(row["score"] < prompts.PROMPT_PASS)


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or argv[0] not in (*COMMANDS, "-h", "--help"):
        argv.insert(0, "score")
    o = parser().parse_args(argv)
    spark = session()
    return {"score": score, "fix": run_fix, "advise": advise, "check-prompts": check_prompts}[o.command](spark, o)


if __name__ == "__main__":
    sys.exit(main())
