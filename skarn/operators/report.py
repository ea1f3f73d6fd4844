"""Recommendations, ranked units and rendered reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.scoring import PASS_MARK, THRESHOLDS

#: Findings and their texts.
FINDINGS = [
    ("High Complexity", "Context window overflow.", "Refactor units."),
    ("Circular Dependency", "Recursive loops.", "Use DI."),
    ("Low Type Safety", "Hallucination of signatures.", "Add PEP 484 hints."),
]
MISSING_AGENTS = ("Missing AGENTS.md", "Agent guesses repository structure.", "Create AGENTS.md.")
READY = "✅ Your codebase looks Agent-Ready!"


def recommendations(results: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """``file, ord, finding, agent_impact, recommendation`` from file results and missing documents, in report order.

    Unlisted values count as harmless: complexity 0, no issues, full coverage.
    """
    rules = [
        F.coalesce("complexity", F.lit(0.0)) > 20,
        F.coalesce("issues", F.lit("")).contains("Circular dependency"),
        F.coalesce("type_coverage", F.lit(100.0)) < 90,
    ]
    rows = None
    for k, (rule, (name, impact, advice)) in enumerate(zip(rules, FINDINGS)):
        part = results.where(rule).select("file", F.lit(k).alias("ord"), F.concat(F.lit(f"{name}: "), "file").alias("finding"), F.lit(impact).alias("agent_impact"), F.lit(advice).alias("recommendation"))
        rows = part if rows is None else rows.unionByName(part)
    if missing is not None:
        name, impact, advice = MISSING_AGENTS
        part = missing.where(F.lower("name") == "agents.md").limit(1).select(F.lit("\U0010ffff").alias("file"), F.lit(9).alias("ord"), F.lit(name).alias("finding"), F.lit(impact).alias("agent_impact"), F.lit(advice).alias("recommendation"))
        rows = rows.unionByName(part)
    return rows


def recommendations_report(rows: list) -> str:
    """Ordered recommendation rows as Markdown."""
    if not rows:
        return f"# Recommendations\n\n{READY}"
    table = "| Finding | Agent Impact | Recommendation |\n| :--- | :--- | :--- |\n"
    return "# Recommendations\n\n" + table + "".join(f"| {r['finding']} | {r['agent_impact']} | {r['recommendation']} |\n" for r in rows)


def ranked(units: DataFrame, by: str = "acl", top: int | None = None, within: str | None = None, ties: tuple[str, ...] = ("name",)) -> DataFrame:
    """Units with ``rank``, highest ``by`` first; at most ``top`` of them, or of each ``within`` group."""
    order = [F.desc(by), *ties]
    if within is None:
        # A global rank is only asked for a report's top rows: sort and limit first, number what is left.
        some = units.orderBy(*order).limit(top) if top is not None else units
        return some.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    rows = units.withColumn("rank", F.row_number().over(Window.partitionBy(within).orderBy(*order)))
    return rows if top is None else rows.where(F.col("rank") <= top)


def over_target(units: DataFrame, yellow: float = THRESHOLDS["acl_yellow"], red: float = THRESHOLDS["acl_red"]) -> DataFrame:
    """Units above the yellow threshold, with their ``status``."""
    return units.where(F.col("acl") > yellow).withColumn("status", F.when(F.col("acl") > red, "🔴 Red").otherwise("🟡 Yellow"))


def acl_section(rows: list[dict], yellow: float = 10, red: float = 15, top: int | None = None, sort_by: str = "acl") -> str:
    """Markdown of the units above target; ``rows`` have ``name, file, acl, loc, complexity``."""
    out = "### 🎯 Agent Cognitive Load (ACL)\n\n"
    bad = sorted((r for r in rows if r["acl"] > yellow), key=lambda r: -r[sort_by])[:top]
    if not bad:
        return out + f"✅ All functions meet the Agent Cognitive Load (ACL) target of <= {yellow}.\n\n"
    out += "| Function | File | ACL | Status |\n| :--- | :--- | :--- | :--- |\n"
    return out + "".join(f"| `{r['name']}` | `{r['file']}` | {r['acl']:.1f} | {'🔴 Red' if r['acl'] > red else '🟡 Yellow'} |\n" for r in bad) + "\n"


def visible(results: DataFrame, verbosity: str = "summary") -> DataFrame:
    """File rows that a verbosity shows: none, those below 100, or all."""
    if verbosity == "quiet":
        return results.where(F.lit(False))
    return results.where(F.col("score") < 100) if verbosity == "summary" else results


def environment_checks(health: dict) -> list[tuple[str, bool | None, str]]:
    """Check, whether it passes (null: nothing was found), and its details."""
    eco = health.get("agentic_ecosystem") or {}
    tools = [*(eco.get("found_frameworks") or []), *["baml"] * bool(health.get("baml_detected"))]
    steering = eco.get("found_files") or []
    return [
        ("AGENTS.md", bool(health["agents_md"]), ""),
        ("Lock File", bool(health["lock_file"]), ""),
        ("Agent Frameworks", True if tools or eco.get("has_agent_frameworks") else None, ", ".join(dict.fromkeys(tools))),
        ("Context Steering", True if eco.get("has_context_files") else None, ", ".join(steering)),
    ]


#: Marks and bonuses of the environment section.
BONUS = {"Agent Frameworks": ("🤖", 10), "Context Steering": ("📜", 5)}


def environment_section(health: dict) -> str:
    if not health:
        return ""
    out = "## 🏗️ Environment Health\n\n| Check | Status |\n| :--- | :--- |\n"
    for name, ok, detail in environment_checks(health):
        icon, points = BONUS.get(name, ("", 0))
        status = f"{icon} [PASS] ({detail}) (+{points})" if points and ok else "🟡 None" if ok is None else "✅ PASS" if ok else "❌ FAIL"
        out += f"| {name} | {status} |\n"
    return out + "\n"


def environment_table(health: dict, entropy: dict, context: dict) -> str:
    """The checks of a project's surroundings as lines of text, with directory entropy and critical context."""
    rows = [(name, ("PASS" if ok else "None" if ok is None else "FAIL") + (f" ({detail})" if detail else "")) for name, ok, detail in environment_checks(health)]
    rows.append(("Directory Entropy", f"{entropy['avg_files']:.1f} files/dir" + (" (warning)" if entropy["warning"] else "")))
    rows.append(("Critical Token Count", f"{context['token_count']:,} tokens" + (" (alert)" if context["alert"] else "")))
    return "Environment Health\n" + "\n".join(f"  {name:<22}{status}" for name, status in rows)


def craft(context: str, request: str, actions: list[str], frame: str, template: str) -> str:
    """A block-quoted prompt of five parts."""
    parts = [("Context", context), ("Request", request), ("Actions", ""), ("Frame", frame), ("Template", template)]
    lines = []
    for name, text in parts:
        lines.append(f"**{name}**: {text}".rstrip() if name == "Actions" else f"**{name}**: {text}")
        if name == "Actions":
            lines += [f"- {a}" for a in actions]
    return "\n".join(f"> {x}" for x in lines)


#: The texts of remediation prompts; braces stand for names.
GOD_MODULE = (
    "You are a Software Architect specializing in modular system design.",
    "Decompose the God Module `{mod}` to reduce context pressure.",
    ["Identify distinct responsibilities within the module.", "Extract logic into cohesive sub-modules.", "Refactor imports to maintain functionality."],
    "Inbound imports must stay below 50. Maintain existing logic.",
    "A refactoring plan followed by the new module code structure.",
)
HIGH_LOAD = (
    "You are a Senior Python Engineer focused on code maintainability.",
    "Refactor functions in `{file}` with Red ACL scores.",
    ["Target functions: {names}.", "Extract nested logic into smaller helper functions.", "Ensure all units result in an ACL score < {yellow}."],
    "Keep functions under 50 lines. Ensure all tests pass.",
    "Markdown code blocks for the refactored code.",
)
LOW_TYPES = (
    "You are a Python Developer focused on static analysis.",
    "Add PEP 484 type hints to `{file}`.",
    ["Analyze functions missing explicit type signatures.", "Add comprehensive type hints to arguments and return values.", "Use the `typing` module for complex structures."],
    "Target {types}% type coverage. Do not change runtime logic.",
    "The full updated content of the Python file.",
)


def filled(parts: tuple, **names: object) -> str:
    context, request, actions, frame, template = parts
    put = lambda s: s.format(**names)
    return craft(context, put(request), [put(a) for a in actions], put(frame), template) + "\n\n"


def remediations(results: list[dict], gods: list[str], thresholds: dict) -> list[tuple[str, str]]:
    """Heading and prompt of each remediation: god modules, then red units and lacking types of files below 90."""
    t = THRESHOLDS | thresholds
    rules = [
        ("High Cognitive Load", HIGH_LOAD, lambda r: [u["name"] for u in r.get("function_metrics") or [] if u["acl"] > t["acl_red"]]),
        ("Low Type Safety", LOW_TYPES, lambda r: r.get("type_coverage", 0) < t["type_safety"]),
    ]
    out = [(f"Project Issue: God Module `{m}`", filled(GOD_MODULE, mod=m)) for m in gods]
    weak = [r for r in results if r.get("score", 0) < 90]
    for r, (kind, parts, applies) in ((r, rule) for r in weak for rule in rules):
        if found := applies(r):
            names = ", ".join(f"`{n}`" for n in found) if isinstance(found, list) else ""
            out.append((f"File: `{r['file']}` - {kind}", filled(parts, file=r["file"], names=names, yellow=t["acl_yellow"], types=t["type_safety"])))
    return out


def god_modules(issues: list[str] | None) -> list[str]:
    """Modules that a project's issues name as god modules."""
    return [m for x in issues or [] if x.startswith("God Module") for m in x.partition(": ")[2].split(", ")]


def prompts_section(results: list[dict], thresholds: dict, issues: list[str] | None = None) -> str:
    """All remediation prompts as Markdown."""
    parts = remediations(results, god_modules(issues), thresholds)
    return "## 🤖 Agent Prompts for Remediation (CRAFT Format)\n\n" + "".join(f"### {head}\n{prompt}" for head, prompt in parts)


def markdown_report(results: list[dict], final: float, path: str, profile: dict, issues: list[str] | None = None, style: str = "full", health: dict | None = None, thresholds: dict | None = None, version: str = "1", title: str = "Report") -> str:
    """The whole report; ``collapsed`` keeps the summary, ``actionable`` leaves out what passes, ``full`` has everything."""
    t = THRESHOLDS | (thresholds or {})
    out = f"# {title} v{version}\n\n**Target**: `{path}`\n**Profile**: {profile.get('description', '')}\n"
    out += f"**Overall Score: {final:.1f}/100** - {'✅ PASSED' if final >= PASS_MARK else '❌ FAILED'}\n\n"
    if issues:
        out += "## ⚠️ Project Issues\n\n" + "".join(f"- {x}\n" for x in issues) + "\n"
    if style == "collapsed":
        return out
    if health:
        out += environment_section(health)
    units = [u | {"file": r["file"]} for r in results for u in r.get("function_metrics") or []]
    out += acl_section(units, t["acl_yellow"], t["acl_red"])
    shown = [r for r in results if style == "full" or r["score"] < PASS_MARK]
    typed = [r for r in results if style == "full" or r.get("type_coverage", 0) < t["type_safety"]]
    if typed:
        out += "### 🛡️ Type Safety\n\n| File | Coverage | Status |\n| :--- | :--- | :--- |\n"
        out += "".join(f"| `{r['file']}` | {r['type_coverage']:.0f}% | {'✅' if r['type_coverage'] >= t['type_safety'] else '❌'} |\n" for r in typed) + "\n"
    out += prompts_section(results, t, issues)
    if shown:
        out += "## 📂 File Analysis\n\n| File | Score | Issues |\n| :--- | :--- | :--- |\n"
        out += "".join(f"| `{r['file']}` | {r['score']} | {r['issues']} |\n" for r in shown)
    return out


def advisor_report(results: list[dict], gods: dict[str, int], entropy: dict[str, int], cycles: list[list[str]], red: float = 15) -> str:
    """What confuses an agent most: heavy units, god modules, cycles, crowded directories."""
    out = "# 🧠 Agent Advisor Report\n\n## 🌀 Hallucination Zones\n\n"
    units = [(u["acl"], u["name"], r["file"]) for r in results for u in r.get("function_metrics") or [] if u["acl"] > red]
    out += "".join(f"- `{n}` in `{f}`: ACL {a:.1f}\n" for a, n, f in sorted(units, reverse=True)) or "None.\n"
    out += "\n## 🏛️ God Modules\n\n" + ("".join(f"- `{m}`: {n} inbound imports\n" for m, n in gods.items()) or "None.\n")
    out += "\n## 🔄 Circular Dependencies\n\n" + ("".join(f"- {' -> '.join([*c, c[0]])}\n" for c in cycles) or "None.\n")
    return out + "\n## 📁 Directory Entropy\n\n" + ("".join(f"- `{d}`: {n} files\n" for d, n in entropy.items()) or "None.\n")


def badge(score: float, name: str = "Agent Score") -> str:
    """An SVG badge; the label truncates the score."""
    color = "#4c1" if score >= 90 else "#97ca00" if score >= 70 else "#dfb317" if score >= 50 else "#e05d44"
    label, left, right = f"{int(score)}/100", 85, 50
    text = lambda x, s: f'<text x="{x}" y="14">{s}</text>'
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{left + right}" height="20" role="img" aria-label="Agent Score: {label}">'
        f"<title>Agent Score: {label}</title>"
        f'<rect width="{left}" height="20" fill="#555"/><rect x="{left}" width="{right}" height="20" fill="{color}"/>'
        f'<g fill="#fff" text-anchor="middle" font-family="Verdana,sans-serif" font-size="11">{text(left / 2, name)}{text(left + right / 2, label)}</g></svg>'
    )
