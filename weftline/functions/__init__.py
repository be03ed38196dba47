"""Part of the weftline engine."""
