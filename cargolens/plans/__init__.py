"""How frames are filtered, joined to their dimensions and related to totals."""
