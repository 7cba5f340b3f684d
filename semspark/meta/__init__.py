"""The model as data: questions about the model are answered from these tables alone."""

from semspark.meta.tables import META_TABLES, column_meanings, concept_cards, coverage, descriptor_cards, meta_tables, write_cards

__all__ = ["META_TABLES", "column_meanings", "concept_cards", "coverage", "descriptor_cards", "meta_tables", "write_cards"]
