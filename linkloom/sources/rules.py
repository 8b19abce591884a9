"""Rule sets: what to read from a page."""

from __future__ import annotations

from collections.abc import Mapping
from copy import deepcopy
from typing import Any

from linkloom import vocabulary as V


def rule(selector: str, attribute: str = "textContent", **more: Any) -> dict[str, Any]:
    return {"selector": selector, "attribute": attribute, **more}


def meta(name: str, by: str = "property") -> dict[str, Any]:
    return rule(f"meta[{by}='{name}']", "content")


def builtin(instance: str) -> dict[str, dict[str, Any]]:
    """The built-in rule sets; selectors are fixed by the markup pages use."""
    own_terms = f"[href*='{instance}{V.TERM_PATH}']"

    def links(selector: str) -> dict[str, Any]:
        found = rule(selector, "href", terms={"attribute": V.ATTR_TERMS})
        return {"s": "source", "o": [found]}

    default = {
        "subject": {
            "s": "source",
            "title": [rule("title")],
            "description": [meta("description", "name")],
            "image": [
                meta("og:image"),
                rule(f"link[rel='{V.REL_IMAGE}']", "href"),
                rule(f"[{V.ATTR_IMAGE}]", "href"),
                rule(f"[{V.ATTR_IMAGE}]", "src"),
            ],
            "contact": [meta(V.META_CONTACT)],
            "type": [meta(V.META_TYPE)],
            "postDate": [
                meta("article:published_time"),
                rule("time[datetime]", "datetime"),
                meta(V.META_POST_DATE),
                rule(f"[{V.ATTR_DATE}]", V.ATTR_DATE),
            ],
            "indexPolicy": [meta(V.META_POLICY, "name")],
            "indexServer": [rule(f"link[rel='{V.REL_INDEX}']", "href")],
            "indexHarmonizer": [meta(V.META_RULES, "name"), rule(f"link[rel='{V.REL_RULES}']", "href")],
        },
        "hashtag": {
            "s": "source",
            "o": [
                rule(V.TERM_ELEMENT),
                rule(
                    f"a[rel~='{V.REL_TERM}']",
                    "href",
                    postProcess={"method": "regex", "params": instance + V.TERM_PATH + "([^/]+)"},
                ),
                # the name of a term URI, not the whole address
                rule(
                    f"link[rel='{V.REL_TERM}']",
                    "href",
                    postProcess={"method": "regex", "params": V.TERM_PATH + "([^/]+)"},
                ),
            ],
        },
        "link": links(f"a[rel='{V.REL_TERM}']:not({own_terms})"),
        "endorse": links(f"[rel~='{V.REL_ENDORSE}']:not({own_terms})"),
        "bookmark": links(f"[rel~='{V.REL_BOOKMARK}']:not({own_terms})"),
        "cite": links(f"[rel~='{V.REL_CITE}']:not({own_terms})"),
        "button": links(f"[rel~='{V.REL_BUTTON}']"),
    }
    open_graph = {
        "subject": {
            "s": "source",
            "title": [meta("og:title")],
            "description": [meta("og:description")],
            "image": [meta("og:image")],
        }
    }
    split = {"method": "split", "params": ","}
    keywords = {
        "hashtag": {
            "s": "source",
            "o": [rule("meta[name='keywords']", "content", postProcess=split, trim=True)],
        }
    }
    ghost = {"hashtag": {"s": "source", "o": [rule("a.gh-article-tag")]}}
    canonical = rule("link[rel='canonical']", "href")
    document = {
        "documentRecord": {
            "textContent": [rule("article"), rule("main"), rule("body")],
            "site": [canonical],
            "path": [canonical],
        }
    }
    sets = {
        "default": ("Default rule set", default),
        "openGraph": ("Open Graph properties", open_graph),
        "keywords": ("Meta keywords as tags", keywords),
        "ghost": ("Ghost article tags", ghost),
        "standardSite": ("Document record for long-form publishing", document),
    }
    return {
        name: {"@id": f"{instance}harmonizer/{name}", "title": title, "mode": "html", "schema": schema}
        for name, (title, schema) in sets.items()
    }


def merge(base: Mapping[str, Any], override: Mapping[str, Any]) -> dict[str, Any]:
    """The override's sections replace the base's; an empty section keeps the base's."""
    return {**base, **{k: v for k, v in override.items() if v != {}}}


class RuleSets:
    def __init__(self, instance: str):
        self._sets = builtin(instance)

    def get(self, name: str) -> dict[str, Any]:
        if not name or not isinstance(name, str):
            raise ValueError("rule set: a name is needed")
        if name not in self._sets:
            raise KeyError(f"Rule set not found: {name}")
        return deepcopy(self._sets[name])

    def list(self) -> list[str]:
        return list(self._sets)

    def register(self, name: str, rules: Mapping[str, Any]) -> None:
        if name in self._sets:
            raise ValueError(f"{name}: a rule set of this name is known")
        if not rules.get("mode"):
            raise ValueError("rule set: mode is missing")
        self._sets[name] = dict(rules)

    def for_mode(self, mode: str) -> list[str]:
        return [n for n, r in self._sets.items() if r["mode"] == mode]

    def schema(self, name: str = "default") -> dict[str, Any]:
        """The sections of a rule set over those of the default one."""
        base = self.get("default")["schema"]
        return base if name == "default" else merge(base, self.get(name)["schema"])
