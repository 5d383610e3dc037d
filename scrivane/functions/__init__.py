"""Column functions that turn values into JSON text."""
