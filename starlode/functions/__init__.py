"""Part of starlode; see the README for the layout."""
