"""Session helpers shared by all plans."""
