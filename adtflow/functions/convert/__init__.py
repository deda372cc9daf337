"""Schemas from and to other languages.

``emit(model, language)`` gives source text, ``read(text, language)`` a model (with a diagnostic where nothing was
found). A language is a table of type names, a way to write a type, and shapes of declarations; see ``LANGUAGES``.
"""

from __future__ import annotations

from adtflow.functions.convert.emitters import EMITTERS
from adtflow.functions.convert.readers import READERS
from adtflow.plans.lang import Diagnostic
from adtflow.plans.model import Model, resolve, visible, visible_data

LANGUAGES = tuple(EMITTERS)


def emit(model: Model, language: str, **options) -> str:
    """Source text of the declarations that are visible to ``language``, in their order; functions in stubs only."""
    shown = [d for d in model.decls if visible(d, language)] if language == "typeshed" else visible_data(model.decls, language)
    return EMITTERS[language](shown, **options)


def read(text: str | None, language: str) -> Model:
    """The model that ``text`` declares, in order of appearance; a diagnostic if it declares nothing."""
    decls = READERS[language](text or "")
    if not decls:
        return Model(diagnostics=[Diagnostic(f"no {language} type definitions found")])
    return resolve(decls)
