"""Tables, schemas, and where they come from and go to."""
