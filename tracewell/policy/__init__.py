"""The rule language: model, packs, compilation to columns, session fold and replay."""
