"""Registry of plan transforms and the registered queries."""

from . import documents, edits, events, feeds, library, queries, timeline, walks, yamls, probing, ownership
