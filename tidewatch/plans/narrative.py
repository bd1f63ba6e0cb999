"""Deterministic text about one threat snapshot, and the compliance report.

A snapshot is one row; the text is put together on the driver.
"""

from __future__ import annotations

import json

HEADLINES = {"normal": "Traffic is normal", "elevated": "Threat level is elevated", "critical": "Threat level is critical"}


def words(tag: str) -> str:
    """A tag is read as its name."""
    return " ".join(tag.split("_")).strip() or "anomaly"


def listed(items: list[str]) -> str:
    return items[0] if len(items) == 1 else ", ".join(items[:-1]) + " and " + items[-1] if items else ""


def span(seconds: float) -> str:
    """Hours, minutes, seconds, two at most."""
    s = max(0, int(seconds))
    h, m = s // 3600, s % 3600 // 60
    return f"{h}h {m}m" if h else f"{m}m {s % 60}s" if m else f"{s}s"


def narrate(snapshot: dict, now: int) -> dict:
    """Headline, paragraphs and bullets.

    ``snapshot``: level, score, since, contributors (model, claim, tag), corroboration, entities (type, id, score, models),
    transition (at, from, to) or None, offline (names); ``level`` None if the fusion itself is not there.
    """
    offline = sorted(snapshot.get("offline") or [])
    gone = [f"No data from {listed(offline)}; the picture may be incomplete."] if offline else []
    level = snapshot.get("level")
    if level is None:
        return {"headline": "Threat level is unknown", "level": "unknown", "paragraphs": gone or ["The fusion service can't be reached."], "bullets": []}
    paragraphs = [f"The score is {snapshot['score']:.2f} and the level has been {level} for {span(now - snapshot['since'])}."]
    ranked = sorted(snapshot.get("contributors") or [], key=lambda c: (-c["claim"], c["model"]))
    if ranked:
        causes = list(dict.fromkeys(words(c["tag"]) for c in ranked))
        text = f"{causes[0][0].upper()}{causes[0][1:]} leads" + (f", with {listed(causes[1:])}" if causes[1:] else "")
        signal = f"{snapshot['corroboration']} models agree on one entity" if snapshot["corroboration"] >= 2 else "single model is driving the signal"
        paragraphs.append(f"{text}; {signal}.")
    else:
        paragraphs.append("No model reports an anomaly.")
    if change := snapshot.get("transition"):
        paragraphs.append(f"It went from {change['from']} to {change['to']} {span(now - change['at'])} ago.")
    entities = snapshot.get("entities") or []
    worth = [e for e in entities if e["models"] >= 2 or e["score"] > 0] or entities
    bullets = [f"{e['type']} {e['id']}: {e['score']:.2f}" + (f" ({e['models']} models)" if e["models"] >= 2 else "") for e in worth[:5]]
    return {"headline": HEADLINES.get(level, f"Threat level is {level}"), "level": level, "paragraphs": paragraphs + gone, "bullets": bullets}


def report(snapshot: dict, history: dict, now: int) -> str:
    """A frozen snapshot as Markdown with its data in JSON (Q12)."""
    text = narrate(snapshot, now)
    lines = [f"# {text['headline']}", "", *text["paragraphs"], "", *[f"- {b}" for b in text["bullets"]], "", f"Score: least {history['min']}, largest {history['max']}, latest {history['latest']}.", "", "```json", json.dumps(snapshot, sort_keys=True), "```"]
    return "\n".join(lines)
