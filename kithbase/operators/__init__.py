"""Part of kithbase."""
