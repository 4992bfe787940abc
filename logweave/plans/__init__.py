"""Session helpers and the composed conversion plans."""
