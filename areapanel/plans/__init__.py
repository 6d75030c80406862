"""Composite operators: cleaning steps, reporting views, the whole run."""
