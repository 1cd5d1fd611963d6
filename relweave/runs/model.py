"""Models that answer prompts: any callable named in the settings, or a service with a chat-completions interface."""

from __future__ import annotations

import importlib
import json
import os
import time
import tomllib
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from relweave.plans.agent import Agent, Packer, Profile, plan_prompt, synth_prompt

#: A prompt in, the answer's text out.
Model = Callable[[str], str]


class HttpModel:
    """A service that takes ``{model, messages}`` and gives ``{choices: [{message: {content}}]}``. Busy and failing services are asked again."""

    def __init__(self, url: str, name: str, key: str | None = None, temperature: float = 0.0, timeout: float = 60.0, retries: int = 2, wait: float = 1.0) -> None:
        self.url, self.name, self.key, self.temperature, self.timeout, self.retries, self.wait = url, name, key, temperature, timeout, retries, wait

    def __call__(self, prompt: str) -> str:
        body = json.dumps({"model": self.name, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for left in range(self.retries, -1, -1):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as e:
                if not left or (e.code < 500 and e.code != 429):
                    raise
            except urllib.error.URLError:
                if not left:
                    raise
            time.sleep(self.wait)
        raise AssertionError("not reached")


def load_settings(path: str | Path | None) -> dict[str, Any]:
    """A TOML file: tables ``model`` (``call = "module:function"``, or ``url``, ``name``, ``key_env``, ...) and ``agent`` (``max_retries``, ``max_tokens``, ...)."""
    data = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    if unknown := set(data) - {"model", "agent"}:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return data


def model_of(settings: Mapping[str, Any], call: str | None = None) -> Model:
    own = dict(settings.get("model", {}))
    if named := call or own.get("call"):
        module, _, name = named.partition(":")
        return getattr(importlib.import_module(module), name)
    if not own.get("url") or not own.get("name"):
        raise ValueError("the settings name no model: a call, or a url and a name")
    key = os.environ.get(own.pop("key_env")) if "key_env" in own else None
    return HttpModel(key=key, **own)


def agent_of(model: Model, providers: Mapping[str, Any], settings: Mapping[str, Any] | None = None) -> Agent:
    """An agent that asks the model for the plan and for the answer."""
    own = dict((settings or {}).get("agent", {}))
    profile = Profile(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.pop("profile", {}).items()})
    packer = Packer(own.pop("max_tokens", 4000), lambda text: text[:400])
    return Agent(
        plan=lambda feature, context: model(plan_prompt(profile, providers, feature, context)),
        synth=lambda feature, context, plan: model(synth_prompt(profile, feature, context, plan)),
        providers=providers,
        packer=packer,
        profile=profile,
        **own,
    )
