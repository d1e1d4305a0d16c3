"""Lists of steps: their saved form, their run over a table or a file, and the record kept of it."""
