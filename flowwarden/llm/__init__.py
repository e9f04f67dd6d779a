"""Training-data operators: deduplication, language and quality models, HTML
extraction, mixing and packing. Nothing else in the library imports this
subpackage; ``queries`` registers one query per operator."""
