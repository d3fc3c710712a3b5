"""robots.txt: groups, longest match, crawl delay, sitemaps, and what an answer to the request for it means."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(body: str | None) -> dict:
    """{"groups": [{"agents", "rules": [(allow, pattern)], "delay"}], "sitemaps"}; lines that make no sense are skipped."""
    groups: list[dict] = []
    sitemaps: list[str] = []
    open_agents = False
    for line in (body or "").splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "sitemap":
            if value:
                sitemaps.append(value)
        elif name == "user-agent":
            if not open_agents:
                groups.append({"agents": [], "rules": [], "delay": None})
            groups[-1]["agents"].append(value.lower())
            open_agents = True
        elif groups and name in ("allow", "disallow"):
            open_agents = False
            if value:
                groups[-1]["rules"].append((name == "allow", value))
        elif groups and name == "crawl-delay":
            open_agents = False
            try:
                delay = float(value)
            except ValueError:
                continue
            if delay >= 0:
                groups[-1]["delay"] = delay
    return {"groups": groups, "sitemaps": sitemaps}


def groups_for(rules: dict, agent: str) -> list[dict]:
    agent = agent.lower()
    own = [g for g in rules["groups"] if any(a != "*" and a and a in agent for a in g["agents"])]
    return own or [g for g in rules["groups"] if "*" in g["agents"]]


def _matches(pattern: str, path: str) -> bool:
    end = pattern.endswith("$")
    body = ".*".join(map(re.escape, pattern.rstrip("$").split("*")))
    return re.match(body + ("$" if end else ""), path) is not None


def allowed(rules: dict, agent: str, path: str) -> bool:
    """The longest matching pattern decides, allow before disallow of the same length; nothing matching allows."""
    best = max(((len(p), ok) for g in groups_for(rules, agent) for ok, p in g["rules"] if _matches(p, path or "/")), default=(0, True))
    return best[1]


def crawl_delay(rules: dict, agent: str) -> float | None:
    """The largest of our group's and the general group's."""
    both = groups_for(rules, agent) + [g for g in rules["groups"] if "*" in g["agents"]]
    return max((g["delay"] for g in both if g["delay"] is not None), default=None)


def decision_for_status(status: int | None) -> str:
    """What the answer means: use the body, allow all, deny all, or unreachable (fail closed)."""
    if status is None or status == 429 or status >= 500:
        return "unreachable"
    if status in (401, 403):
        return "deny"
    return "use" if 200 <= status < 300 else "allow"


# --- columns -----------------------------------------------------------------------------------------


def status_decision(status: Column) -> Column:
    """CR-23 by columns."""
    return (
        F.when(status.isNull() | (status == 429) | (status >= 500), "unreachable").when(status.isin(401, 403), "deny")
        .when((status >= 200) & (status < 300), "use").otherwise("allow")
    )


def path_allowed(path: Column, rules: dict, agent: str) -> Column:
    """Whether rules let an agent fetch a path, without a join: the rules of one file are an array in the plan."""
    own = [(ok, p) for g in groups_for(rules, agent) for ok, p in g["rules"]]
    if not own:
        return F.lit(True)
    pattern = lambda p: "^" + ".*".join(map(re.escape, p.rstrip("$").split("*"))) + ("$" if p.endswith("$") else "")
    hits = [F.when(path.rlike(pattern(p)), F.struct(F.lit(len(p)).alias("n"), F.lit(ok).alias("ok"))) for ok, p in own]
    return F.coalesce(F.array_max(F.array_compact(F.array(*hits)))["ok"], F.lit(True))
