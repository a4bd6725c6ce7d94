"""Table-driven parsers: bundled grammars, LALR tables, a generalised LR run."""
