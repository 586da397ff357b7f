"""How plans are cut into steps: tables in the shared folder, iteration, global ranks."""
