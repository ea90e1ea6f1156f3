"""Column builders: pure expressions that stay inside whole-stage codegen."""
