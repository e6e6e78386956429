"""Learn the quality rules and write them to ``quality_rules.py``: ``python -m millrace.llm.quality_learn``."""

from __future__ import annotations

from pathlib import Path

from millrace.llm.quality import Rule, learn


def written(lists: list[list[Rule]]) -> str:
    """The rule lists as Python source."""
    lines = ['"""Rule lists of text quality: written by ``python -m millrace.llm.quality_learn``, not by hand."""', "", "RULES = ["]
    for rules in lists:
        lines.append("    [")
        for rule in rules:
            conditions = ", ".join(f'("{f}", "{">" if up else "<="}", {v!r})' for f, up, v in rule.conditions)
            lines.append(f'        ("{rule.kind}", [{conditions}]),')
        lines.append("    ],")
    return "\n".join([*lines, "]", ""])


if __name__ == "__main__":
    Path(__file__).with_name("quality_rules.py").write_text(written(learn()))
