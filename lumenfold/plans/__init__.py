
from lumenfold.plans import registry

registry.load()
