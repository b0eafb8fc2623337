"""Part of sondage."""
