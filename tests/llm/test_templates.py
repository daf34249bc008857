"""The template compiler's corners: literals that look like tags, misplaced branches, and folding."""

from __future__ import annotations

import random

import pytest

from martlens.llm import template
from martlens.llm.template import TemplateError, compile_template


def out(source, **env):
    return list(compile_template(source, {"up": lambda v: str(v).upper()})(env))


def test_literals_that_look_like_tags():
    joined = lambda s, **env: "".join(t for t, _ in out(s, **env))
    assert joined("{{ 'a}}b' }}|{% if x == '%}' %}yes{% endif %}|{{ '{{' + '\\'}}' }}", x="%}") == "a}}b|yes|{{'}}"
    assert joined("{% set it = 'x%}y' %}{{ it }} }} %}") == "x%}y }} %}"
    with pytest.raises(TemplateError):
        out("{{ 'open }}")


@pytest.mark.parametrize("bad", ["{% set %}", "{% set 1a = 'x' %}", "{% set a b = 'x' %}", "{% set a == 'x' %}", "{% if a %}{% else %}{% else %}{% endif %}", "{% if a %}{% else %}{% elif b %}{% endif %}", "{% else %}", "{% endif %}", "{% if a %}{% endfor %}", "{% for x in y %}{% else %}{% endfor %}"])
def test_what_is_not_accepted(bad):
    with pytest.raises(TemplateError):
        out(bad)


PIECES = ["text", "{{ 'a' + 'b' | up }}", "{{ x }}", "{{ 1 + 2 }}", "{{ m.k['z'] }}", "{% if 1 == 1 %}t{% else %}f{% endif %}", "{% if x == 'v' and not '' %}v{% elif 'q' %}q{% endif %}", "{% if '' or x %}o{% endif %}", "{% for i in xs %}{{ i | up }}{% if loop.first %}{{ 'f' }}{% endif %}{% endfor %}", "{% for i in xs %}{% endfor %}", "{% generation %}{{ 'g' }}{{ x }}{% endgeneration %}", "{% set y = 'c' + 'd' %}{{ y }}", "{% set x = x + '1' %}"]


def test_folding_leaves_output_as_it_is(monkeypatch):
    rng = random.Random(3)
    sources = ["".join(rng.choices(PIECES, k=rng.randrange(1, 9))) for _ in range(300)]
    env = lambda: {"x": "v", "xs": iter(["a", "b"]), "m": {"k": {"z": "deep"}}}
    merged = lambda stream: [c for t, marked in stream for c in zip(t, [marked] * len(t), strict=True)]
    folded = [merged(out(s, **env())) for s in sources]
    monkeypatch.setattr(template, "fold_body", lambda body, filters: body)
    assert [merged(out(s, **env())) for s in sources] == folded
